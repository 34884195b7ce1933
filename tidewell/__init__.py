"""Tidewell: a Spark-native engine for time-series and event tables."""
