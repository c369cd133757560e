"""Spark-native archive, search and analytics engine."""

__version__ = "0.1.0"
