"""Incremental (stream) forms of the batch operators."""
