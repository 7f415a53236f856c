"""Spark-native analytics for conversation transcripts."""

__version__ = "0.1.0"
