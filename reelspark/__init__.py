"""Spark-native media search analytics."""
