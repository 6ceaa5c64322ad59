"""Connected components by alternating large and small stars.

Each round joins every node's neighbours to the smallest of them, first for the
larger neighbours, then for the smaller; rounds are stored in the shared folder
and end when a round changes nothing. What is left is one star per component,
around its smallest node. Minima are pre-aggregated per task, and the joins
have one row per node on one side, so a node with very many links is split by
adaptive execution; no edge list goes to the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b: long) -> node, root for every linked node but the roots
    themselves; root is the smallest node of the component."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .filter("u <> v").distinct(), "edges")
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.*").filter("u <> v").distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
