"""Spark-native data preparation and analysis: DataFrame in, DataFrame out."""

__version__ = "0.1.0"
