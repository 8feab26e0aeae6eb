"""Spark-native retrieval and extraction over captured web pages."""
