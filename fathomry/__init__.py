"""Spark-native document retrieval, grounding and training-data analytics."""
