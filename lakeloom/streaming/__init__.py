"""Sensors and schedules as Structured Streaming."""
