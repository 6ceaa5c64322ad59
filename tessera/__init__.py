"""tessera: a Spark-native engine that turns documents and text tables into
instruction datasets (clean -> chunk -> generate -> embed -> export), with
statistics and exact cosine top-k search. Every operator is a DataFrame or
Column function, so batch jobs and Structured Streaming share the same code."""

__version__ = "0.1.0"
