"""Operators for training data: archives, duplicates, contamination, tokens, language, toxicity, secrets, chat, shards."""
