"""Spark-native analytics for log-structured storage metadata."""
