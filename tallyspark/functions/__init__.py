"""Usage analytics on Spark: functions."""
