"""Spark-native document retrieval, ranking and evaluation."""
