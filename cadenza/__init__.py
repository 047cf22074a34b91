"""Cadenza: a PySpark-native engine for music-library analysis and corpus preparation."""

__version__ = "0.1.0"
