"""Spark-native transcript correction, evaluation and retrieval."""
