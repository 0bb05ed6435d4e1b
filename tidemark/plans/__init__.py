"""Registered queries with their DuckDB twins."""
