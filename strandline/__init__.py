"""Spark-native engine for retrieval analytics, answer evaluation and corpus work."""

__version__ = "0.1.0"
