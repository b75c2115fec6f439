"""Timing-telemetry analytics as DataFrame, Spark SQL and Structured Streaming operators."""
