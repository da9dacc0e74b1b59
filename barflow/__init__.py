"""Spark-native analytics for panels of price bars."""
