"""The registered queries once more, in SQL for DuckDB."""
