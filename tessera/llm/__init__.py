"""Operators for training-data pipelines: one module per operator, queries and
DuckDB oracle SQL in ``queries`` and ``oracle``. Nothing outside this
subpackage imports it."""
