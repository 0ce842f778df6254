"""Spark-native operators over time-stamped text and job tables."""

__version__ = "0.1.0"
