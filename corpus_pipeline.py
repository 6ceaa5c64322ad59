"""A training-corpus pipeline: five stages over the ``documents`` table.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir), works on all
that its predecessor kept, and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents`` (extra columns pass through).

1. quality: documents that the co-trained classifier rejects go.
2. near_duplicates: of each component of near-duplicates one document stays.
3. repeated_passages: words covered by a window that an earlier document also has are cut;
   a document left without a word goes, and n_chars follows the text.
4. decontaminated: documents that hold a benchmark item go.
5. packed: every document that is left, as pieces in sequences of at most 2048 tokens.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage, table
from tessera.llm.decontamination import drop_contaminated
from tessera.llm.packing import pack_documents
from tessera.llm.quality import keep_good
from tessera.llm.simhash_dedup import keep_one
from tessera.llm.substring_dedup import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = drop_repeats(docs)
    n_words, n_removed = cut.columns[-2:]
    left = cut.filter((F.col(n_removed) == 0) | (F.col(n_removed) < F.col(n_words)))
    length = F.when(F.col(n_removed) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [(f.__name__, f) for f in (quality, near_duplicates, repeated_passages, decontaminated, packed)]

#: Classifier and SimHash have no SQL form; tests/llm check the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
