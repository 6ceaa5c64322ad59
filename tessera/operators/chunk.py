"""Generators that split one text into many rows: overlapping character
chunks, sentence groups and paragraphs.

The overlapping chunker is sequential inside one text (each start depends on
the previous chunk's end) and parallel across texts. Cleaning (the regex
work) is a JVM expression. The walk is a map over Arrow batches: the places
of all sentence terminators are found once per text, each window looks up
the last one in its range by bisection, and chunks are cut by index, so a
text of any length takes linear time. (A JVM loop would append to an array
and cut from a variable-width string, both linear per step.) Chunks leave as rows, in
batches of bounded size, as they are cut.

Native array expressions are built inside the generator with let-bound inner
values (``transform(array(x), f)[0]``): building them with ``withColumn`` first
lets the optimizer copy the cleaning regexes into an inferred size filter."""
from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SENTENCE_TERMINATORS, chunk_clean, paragraphs, split_sentences
from tessera.session import ensure_on_executors

DEFAULT_CHUNK_SIZE = 1000
DEFAULT_CHUNK_OVERLAP = 200
DEFAULT_SENTENCES_PER_CHUNK = 5
BOUNDARY_LOOKBACK = 100
BOUNDARY_LOOKAHEAD = 50
OUT_BYTES = 1 << 20  # of a batch of chunks
ROW_BYTES = 64  # of a chunk besides its characters

_ENDS = re.compile("[" + re.escape(SENTENCE_TERMINATORS) + "]")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and use it in ``body`` (no re-evaluation)."""
    return F.transform(F.array(value), body)[0]


def iter_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the overlapping windows of a cleaned text. A window ends
    ``size`` characters on, or just after the last sentence terminator around that
    place (100 before to 50 behind) if the text goes on and that lies past its middle."""
    after = [m.end() for m in _ENDS.finditer(text)]
    total, start = len(text), 0
    while start < total:
        end = start + size
        if end < total:
            # the last terminator that ends in (end - 100, end + 50]
            k = bisect_left(after, min(end + BOUNDARY_LOOKAHEAD, total) + 1) - 1
            if k >= 0 and after[k] > max(end - BOUNDARY_LOOKBACK, start, start + size // 2):
                end = after[k]
        yield start, end
        start = max(start + 1, end - overlap)


def chunk_spans(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    return list(iter_spans(text, size, overlap))


def _walker(size: int, overlap: int):
    """Batches (text, kept) -> batches of chunks with their text's ``kept``, of about ``OUT_BYTES`` each, so a
    task holds no more than that of its output, however many chunks a text has. Python slices by index
    in O(1), while a JVM ``substring`` on a long variable-width string walks from its start."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, kept = batch.columns
            rows, index, starts, ends, chunks = [], [], [], [], []

            def flush(kept=kept, kind=texts.type):
                out = pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int32()) for c in (index, starts, ends)), pa.array(chunks, kind), kept.take(pa.array(rows, pa.int64()))],
                    ["chunk_index", "chunk_start", "chunk_end", "chunk", "kept"])
                for c in (rows, index, starts, ends, chunks):
                    c.clear()
                return out

            held = 0
            for row, value in enumerate(texts):
                text = value.as_py()
                if not text:
                    continue
                n, i, each = len(text), 0, kept.slice(row, 1).nbytes
                for a, b in iter_spans(text, size, overlap):
                    chunk = text[a:b].strip(" ")
                    if not chunk:
                        continue
                    rows.append(row)
                    index.append(i)
                    starts.append(a)
                    ends.append(b if b < n else n)
                    chunks.append(chunk)
                    i += 1
                    held += ROW_BYTES + len(chunk) + each
                    if held >= OUT_BYTES:
                        yield flush()
                        held = 0
            if rows:
                yield flush()
    return run


def chunk_text(df: DataFrame, text_col: str = "text", size: int = DEFAULT_CHUNK_SIZE,
               overlap: int = DEFAULT_CHUNK_OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: ``keep`` columns + chunk_index, chunk_start, chunk_end, chunk.

    ``chunk_index`` counts emitted chunks per text from 0. Null or blank texts
    give no rows. Cleaning runs in the JVM, the walk over Arrow batches."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    ensure_on_executors(df.sparkSession)
    # only the keys and the cleaned text travel to Python
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    src = df.select(chunk_clean(F.col(text_col)).alias("chunk"), kept.alias("kept"))
    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("chunk_index", "chunk_start", "chunk_end")),
                           T.StructField("chunk", T.StringType()), T.StructField("kept", src.schema["kept"].dataType)])
    out = src.mapInArrow(_walker(size, overlap), schema)
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), "chunk_index", "chunk_start", "chunk_end", "chunk")


def sentence_groups(sentences: Column, k: int) -> Column:
    """Groups of ``k`` sentences joined by one space (last group may be short)."""
    if k <= 0:
        raise ValueError("sentences per chunk must be positive")
    n_groups = F.floor((F.size(sentences) + F.lit(k - 1)) / F.lit(k)).cast("int")
    idx = F.sequence(F.lit(0), n_groups - 1)
    groups = F.transform(idx, lambda i: F.trim(F.array_join(F.slice(sentences, i * k + 1, F.lit(k)), " ")))
    return F.when(n_groups > 0, F.filter(groups, lambda g: g != "")).otherwise(
        F.array().cast("array<string>"))


def chunk_by_sentences(df: DataFrame, text_col: str = "text", k: int = DEFAULT_SENTENCES_PER_CHUNK,
                       keep: list[str] | None = None) -> DataFrame:
    """One row per group of ``k`` sentences of the cleaned text: keep + chunk_index, chunk."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    arr = _let(split_sentences(chunk_clean(F.col(text_col))), lambda s: sentence_groups(s, k))
    return df.select(*keep, F.posexplode(arr).alias("chunk_index", "chunk"))


def explode_sentences(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per sentence of the cleaned text: keep + sentence_index, sentence."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    return df.select(*keep, F.posexplode(split_sentences(chunk_clean(F.col(text_col))))
                     .alias("sentence_index", "sentence"))


def explode_paragraphs(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per paragraph (blank-line separated, stripped, non-empty)."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    return df.select(*keep, F.posexplode(paragraphs(F.col(text_col))).alias("para_index", "text"))
