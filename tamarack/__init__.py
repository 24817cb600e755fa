"""Spark-first retrieval and corpus analytics: every operator is a DataFrame in, DataFrame out plan."""

__version__ = "0.1.0"
