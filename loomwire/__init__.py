"""Spark-native analytics for news and event streams."""
