"""Spark-first data preparation, analytics and training-data operators."""
