"""Structured Streaming forms of the monitors."""
