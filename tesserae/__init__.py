"""Tesserae: a Spark-native catalog analytics engine."""

__version__ = "0.1.0"
