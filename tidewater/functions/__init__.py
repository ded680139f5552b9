"""Functions of the report engine."""
