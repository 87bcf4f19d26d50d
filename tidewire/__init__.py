"""Spark-native news-event analytics."""
