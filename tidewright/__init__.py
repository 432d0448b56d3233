"""Spark-native analytics for panels of daily price series."""
