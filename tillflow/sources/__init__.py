"""Readers.  Each returns a DataFrame; none starts a job."""
