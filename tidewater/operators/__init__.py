"""Operators of the report engine."""
