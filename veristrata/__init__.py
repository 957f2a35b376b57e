"""Spark-native engine for versioned relational facts, document evidence and corpus preparation."""

__version__ = "0.1.0"
