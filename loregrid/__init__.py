"""Spark-native hybrid retrieval, context assembly and training-data preparation."""
