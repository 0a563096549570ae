"""Spark-native pairwise coalescence analytics."""

__version__ = "0.1.0"
