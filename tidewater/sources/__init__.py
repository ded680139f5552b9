"""Sources of the report engine."""
