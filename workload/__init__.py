"""Queries over the test tables, and the same questions as SQL for DuckDB."""
