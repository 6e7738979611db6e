"""Spark-native entity resolution, retrieval, evaluation and annotation analytics."""
