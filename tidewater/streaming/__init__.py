"""Streaming of the report engine."""
