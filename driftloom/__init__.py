"""Spark-native generation, drift, repair, forecasting and profiling of tables and series."""

__version__ = "0.1.0"
