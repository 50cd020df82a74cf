"""Spark-native corpus analytics and hybrid retrieval."""

__version__ = "0.1.0"
