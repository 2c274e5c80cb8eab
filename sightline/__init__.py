"""Spark-native evidence and scene analytics."""
