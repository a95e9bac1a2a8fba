"""Structured Streaming jobs over event logs."""
