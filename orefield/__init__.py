"""Spark-first evidence retrieval and corpus processing: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
