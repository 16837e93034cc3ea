"""Spark-native analytics over agent telemetry, retrieval and content ingestion."""
