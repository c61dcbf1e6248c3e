"""Spark-native early-warning analytics: messy records in, calibrated risk tables out."""

__version__ = "0.1.0"
