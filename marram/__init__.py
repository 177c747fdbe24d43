"""Spark-native analytics for multi-entity sensor logs, with a text-corpus toolkit beside it."""
