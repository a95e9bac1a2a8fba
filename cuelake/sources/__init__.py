"""Readers, sinks and the tables derived from the test data."""
