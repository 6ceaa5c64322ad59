"""Row identity, slicing and text-validity filters for tables of text."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import MIN_DATASET_TEXT, valid_text, ws_collapse, wrap_dataset_chunk
from tessera.session import scratch_path


def require_text_column(df: DataFrame, text_col: str) -> None:
    """Fail early, listing what exists, when the text column is missing."""
    if text_col not in df.columns:
        raise ValueError(f"no column {text_col!r} in this table; it has {', '.join(df.columns)}")


def _free(df: DataFrame, *names: str) -> list[str]:
    """The names, with ``_`` before each that the frame already uses."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := "_" * i + name).lower() not in taken) for name in names]


def zip_index(df: DataFrame, name: str = "idx", order_cols: list[str] | None = None) -> DataFrame:
    """0-based dense position of every row, natively (no Python round trip).

    The rows (range-partitioned and sorted by ``order_cols`` if given, else in their
    current order) are written once to the shared checkpoint folder together
    with their partition and place in it; both the counts per partition and
    the numbers come from that stored copy, so they cannot disagree. Order columns
    must be unique for a reproducible numbering; ties are numbered in any order,
    but never share a number."""
    if order_cols:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    mid, pid, start = _free(df, "mid", "pid", "start")
    path = scratch_path(df.sparkSession, "numbered")
    placed = df.withColumn(mid, F.monotonically_increasing_id()).withColumn(pid, F.shiftright(mid, 33))
    placed.write.parquet(path)
    s = df.sparkSession.read.schema(placed.schema).parquet(path)
    # a partition's rows run from its least id on; one row per partition is prefix-summed
    counts = s.groupBy(pid).agg(F.count(F.lit(1)).alias("n"), F.min(mid).alias("least"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(pid, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias(start))
    return s.join(offsets, pid).withColumn(name, (F.col(start) + F.col(mid)).cast("long")).drop(mid, pid, start)


ROWS_PER_BLOCK = 1 << 20


def with_row_index(df: DataFrame, name: str = "real_index", bare_scan: bool = False) -> DataFrame:
    """Attach each row's position in the frame (0-based, long), file by file in
    path order.

    Rows of a file scan are counted as they are in ``df``, filters included, per
    file and block of it (a run of row numbers in Parquet, a split in text
    formats); prefix sums give each block's start, and rows are ranked inside
    their block, so no task holds a whole file. ``bare_scan=True`` asserts an
    unfiltered Parquet scan: then the row number in its file is used directly,
    no row is shuffled, and for one file a range filter on it is pushed to
    the scan. Frames that are no file scan are numbered by ``zip_index``."""
    file, row, block, start = _free(df, "file", "row", "block", "start")
    meta = None
    for place in (F.col("_metadata.row_index"), None):
        try:
            at = place if place is not None else F.monotonically_increasing_id()
            cut = F.floor(place / ROWS_PER_BLOCK) if place is not None else F.col("_metadata.file_block_start")
            meta = df.select("*", F.col("_metadata.file_path").alias(file), cut.alias(block), at.alias(row))
            break
        except AnalysisException:  # not a file scan, or one without row numbers
            continue
    if meta is None:
        return zip_index(df, name)
    if bare_scan and place is not None and len(df.inputFiles()) <= 1:
        return df.select("*", F.col("_metadata.row_index").cast("long").alias(name))
    counts = meta.groupBy(file, block).agg(F.count(F.lit(1)).alias("n"))
    # per file first, so that the ordered window has one row per file
    files = counts.groupBy(file).agg(F.sum("n").alias("n"))
    files = files.select(file, F.coalesce(F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    if bare_scan and place is not None:
        starts = files.select(file, F.col("first").alias(start))
        return meta.join(starts, file).withColumn(name, (F.col(start) + F.col(row)).cast("long")).drop(file, row, block, start)
    inside = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(files, file).select(file, block, (F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias(start))
    rank = F.row_number().over(Window.partitionBy(file, block).orderBy(row))
    return (meta.withColumn(row, rank).join(starts, [file, block])
            .withColumn(name, (F.col(start) + F.col(row) - 1).cast("long")).drop(file, row, block, start))


def slice_rows(df: DataFrame, start: int = 0, max_samples: int | None = None,
               index_col: str = "real_index", total: int | None = None) -> DataFrame:
    """Rows with index in ``[start, start + max_samples)``; a falsy max means all.

    ``start`` past the end is an error, as in the reference; pass ``total`` to
    skip the count. The range filter reaches the scan as a pushed predicate."""
    if start < 0:
        raise ValueError("start index must not be negative")
    n = total if total is not None else df.count()
    if start >= n:
        raise ValueError(f"cannot start at row {start}: the table ends after {n} rows")
    cond = F.col(index_col) >= start
    if max_samples:
        cond = cond & (F.col(index_col) < start + max_samples)
    return df.filter(cond)


def filter_valid_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Keep rows whose text is a non-null, non-blank string."""
    require_text_column(df, text_col)
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        # non-string values are skipped, never cast
        return df.filter(F.lit(False))
    return df.filter(valid_text(text_col))


def filter_min_length(df: DataFrame, text_col: str = "text", min_chars: int = MIN_DATASET_TEXT) -> DataFrame:
    """Keep rows whose whitespace-collapsed text has at least ``min_chars`` characters."""
    return df.filter(F.length(ws_collapse(text_col)) >= min_chars)


def dataset_chunks(df: DataFrame, text_col: str = "text", index_col: str = "real_index") -> DataFrame:
    """The table path's (real_index, chunk) rows: valid text, collapsed, at
    least 10 characters, wrapped in the dataset-chunk banner."""
    valid = filter_valid_text(df, text_col)
    # The empty-result check sits inside an outer generator: a plain filter on
    # the wrapped text would be pushed below the projection and run the
    # whitespace regex twice; an inner generator would get an inferred filter
    # that copies it too. Rows that produce nothing come out as null.
    kept = F.filter(F.array(wrap_dataset_chunk(text_col)), lambda x: x != "")
    return (valid.select(F.col(index_col).alias("real_index"), F.explode_outer(kept).alias("chunk"))
            .filter(F.col("chunk").isNotNull()))
