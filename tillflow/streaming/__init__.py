"""Streaming forms of the operators, and the queries that run them."""
