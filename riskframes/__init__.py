"""Spark-native engine for aligned time-series panels, scenarios and tail-risk decisions."""
