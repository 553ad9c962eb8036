"""Spark-native analytics over endpoint-telemetry events."""
