"""Structured Streaming twins of the telemetry operators."""
