"""Spark-native k-mer presence/absence analytics."""

__version__ = "0.1.0"
