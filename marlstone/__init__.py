"""Marlstone: a PySpark-native analytics library for panels, linkage, data quality, text and tick data."""

__version__ = "0.1.0"
