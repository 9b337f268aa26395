"""Spark-native analytics over long-form prose."""
