"""Token counts: an exact length histogram with suffix sums.

Every whole document is encoded once; lengths are counted per batch, then per
length over all documents. Suffix sums over the histogram then answer, for every
context limit, totals, quantiles and what truncation at that limit would leave.
The sums run in two levels (blocks of lengths, then inside a block), so no task
gets the whole histogram.

Defined cases: null or blank text has length 0; a very long text is encoded word by word; a quantile
that falls on a step takes the shorter length; repeated rows count each; an
empty table gives an empty histogram; only the text column is read."""
from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship
from tessera.llm.tokens import vocabulary_path, word_ids

BLOCK = 1024


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""
    path = vocabulary or vocabulary_path()

    def lengths(batches):
        import pyarrow as pa

        encoder = word_ids(path)
        for batch in batches:
            seen = Counter(len(encoder.encode(t.as_py())) // 4 for t in batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                                             ["n_tokens", "n_docs"])

    counted = ship(docs).select(F.col("text").cast("binary")).mapInArrow(lengths, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_table(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit L: docs_from and
    tokens_from (documents of at least L tokens and their tokens), docs_to and
    tokens_to (those of at most L), truncated_tokens (sum of min(length, L))
    and share_to (share of documents that fit, the quantile of L)."""
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    # blocks of blocks, so that this window stays small as well
    wide = blocks.withColumn("wide", F.floor(F.col("block") / BLOCK))
    tops = wide.groupBy("wide").agg(F.sum("bd").alias("wd"), F.sum("bt").alias("wt"))
    every = Window.orderBy(F.desc("wide"))
    tops = tops.select("wide", (F.sum("wd").over(every) - F.col("wd")).alias("wd0"), (F.sum("wt").over(every) - F.col("wt")).alias("wt0"),
                       F.sum("wd").over(Window.partitionBy()).alias("all_docs"), F.sum("wt").over(Window.partitionBy()).alias("all_tokens"))
    inner = Window.partitionBy("wide").orderBy(F.desc("block"))
    blocks = wide.join(tops, "wide").select(
        "block", (F.sum("bd").over(inner) - F.col("bd") + F.col("wd0")).alias("bd0"),
        (F.sum("bt").over(inner) - F.col("bt") + F.col("wt0")).alias("bt0"), "all_docs", "all_tokens")
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    out = h.join(blocks, "block").select(
        "n_tokens", "n_docs", "tokens", (F.sum("n_docs").over(within) + F.col("bd0")).alias("docs_from"),
        (F.sum("tokens").over(within) + F.col("bt0")).alias("tokens_from"), "all_docs", "all_tokens")
    to = F.col("all_docs") - F.col("docs_from") + F.col("n_docs")
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_from", "tokens_from", to.alias("docs_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("tokens")).alias("tokens_to"),
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_tokens"),
        (to / F.col("all_docs")).alias("share_to"))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for any limits L, whether or not a document has that length:
    docs_over, truncated_tokens (sum of min(length, L)) and lost_tokens."""
    spark = table.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("context_limit"))
    over = F.col("n_tokens") > F.col("context_limit")
    each = table.select("n_tokens", "n_docs", "tokens").join(F.broadcast(asked))  # the stated limits against all lengths
    return each.groupBy("context_limit").agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.when(over, F.col("context_limit") * F.col("n_docs")).otherwise(F.col("tokens"))).alias("truncated_tokens"),
        F.sum(F.when(over, F.col("tokens") - F.col("context_limit") * F.col("n_docs")).otherwise(0)).alias("lost_tokens"))


def quantile_length(table: DataFrame, q: float) -> DataFrame:
    """The smallest length L with at least a share q of documents of at most L tokens."""
    return table.filter(F.col("share_to") >= q).agg(F.min("n_tokens").alias("n_tokens"))
