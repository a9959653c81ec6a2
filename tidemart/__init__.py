"""Retail real-time data mart on Spark: batch and Structured Streaming."""
