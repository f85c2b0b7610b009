"""Sensor-session analytics as Spark jobs."""
