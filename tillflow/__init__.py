"""tillflow: real-time shop analytics on Spark DataFrames and Structured Streaming."""
