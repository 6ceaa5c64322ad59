"""End-to-end plans, the query catalogue and its DuckDB oracle."""
