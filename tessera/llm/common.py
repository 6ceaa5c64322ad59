"""Helpers shared by the training-data operators."""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_on_executors, scratch_path

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage
    ends there, and a lost executor never forces an earlier step to run again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Jobs run inside hand Python workers batches of about ``limit`` bytes at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ship(df: DataFrame) -> DataFrame:
    """Make this package importable in the Python workers that will read ``df``."""
    ensure_on_executors(df.sparkSession)
    return df


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many ``_`` before it as make it new to
    ``df``: helper columns never clash with extra columns of the input."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null or blank: empty."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def text_blocks(texts: Iterable[bytes | None], limit: int = 1 << 21) -> Iterable[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts of at most ``limit`` bytes together
    (a longer text stands alone), so that work arrays stay small."""
    start = size = 0
    i = -1
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if i >= start:
        yield start, i + 1
