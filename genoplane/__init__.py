"""Genoplane: Spark-native feature engineering and leakage-safe evaluation for genome tables."""

__version__ = "0.1.0"
