"""Spark-native engine for replicated, timestamped table mutations."""

__version__ = "0.1.0"
