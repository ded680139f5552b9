"""Plans of the report engine."""
