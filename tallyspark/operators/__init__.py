"""Usage analytics on Spark: operators."""
