"""Spark-native analytics over build telemetry: fleet counters, rollups, log analysis, snapshots and placement."""
