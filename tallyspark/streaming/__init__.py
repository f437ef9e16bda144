"""Usage analytics on Spark: streaming."""
