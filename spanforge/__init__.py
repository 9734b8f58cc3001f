"""Spark-first analytics for time-grounded text data."""
