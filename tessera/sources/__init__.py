"""Readers (tables of text, text files, page extractors) and sinks."""
