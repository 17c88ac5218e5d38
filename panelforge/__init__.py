"""Spark-native analytics over daily panels."""
