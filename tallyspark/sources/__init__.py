"""Usage analytics on Spark: sources."""
