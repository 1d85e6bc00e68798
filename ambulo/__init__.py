"""Spark-native analytics for multi-day wearable recordings."""
