"""Usage analytics on Spark: plans."""
