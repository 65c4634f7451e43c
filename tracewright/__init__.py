"""Spark-native analytics for text attribution: build, attack, link, measure."""

__version__ = "0.1.0"
