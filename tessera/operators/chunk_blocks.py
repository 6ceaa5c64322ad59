"""The overlapping chunker for very long texts: one text over as many tasks as it has blocks.

Where a chunk starts depends on all chunks before it, but only through one number: where the first
chunk of a block starts. A step is at most ``size + BOUNDARY_LOOKAHEAD - overlap`` characters, so that
entry is one of so many places. Three steps, exact and without guessing:

1. per block, a transfer table: for each possible entry, the entry of the next block and the number of
   chunks between. The step from every place of the block is computed at once, and jumps are doubled
   until all have left the block;
2. per text, the tables are followed from block to block: one look-up each (a value of Spark has at most
   2 GB, so a text has at most some 2,000 blocks of the default length);
3. per block, the walk from its entry cuts the chunks.

Cleaning stays one native expression over a text, and cutting it into blocks one pass; the blocks, each
with the characters its last window looks ahead, are stored in the shared folder and dealt evenly. A text of one block takes
step 3 alone.

Rows, columns and defined cases are those of ``chunk.chunk_text``: null and blank texts give no rows,
``chunk_index`` counts the chunks of a text that are not blank."""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import SENTENCE_TERMINATORS, chunk_clean
from tessera.operators.chunk import BOUNDARY_LOOKAHEAD, BOUNDARY_LOOKBACK, DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, OUT_BYTES, ROW_BYTES
from tessera.session import ensure_on_executors, scratch_path

BLOCK_CHARS = 1 << 20
MANY_TASKS = 128
TASK_CHARS = 1 << 24  # that a task cuts, once there are MANY_TASKS


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Block:
    """Windows of a stretch of a cleaned text: ``part`` is the block's own ``length`` characters with what its
    windows look ahead, ``rest`` the characters from the block's start to the end of the text."""

    def __init__(self, part: str, length: int, rest: int, size: int, overlap: int):
        import numpy as np

        self.length, self.rest, self.size, self.overlap = length, rest, size, overlap
        self.codes = _codes(part)
        self.after = np.flatnonzero(np.isin(self.codes, _codes(SENTENCE_TERMINATORS))) + 1

    @cached_property
    def dark(self):
        """Characters before each place that are not spaces."""
        import numpy as np

        return np.concatenate([[0], np.cumsum(self.codes != ord(" "))])

    def ends(self, starts):
        """Where the windows that start at ``starts`` end (not cut at the end of the text)."""
        import numpy as np

        end = starts + self.size
        if not len(self.after):
            return end
        k = np.searchsorted(self.after, np.minimum(end + BOUNDARY_LOOKAHEAD, self.rest), side="right") - 1
        last = np.where(k >= 0, self.after[np.maximum(k, 0)], -1)
        least = np.maximum(np.maximum(end - BOUNDARY_LOOKBACK, starts), starts + self.size // 2)
        return np.where((end < self.rest) & (last > least), last, end)

    def step(self, starts, ends):
        import numpy as np

        return np.maximum(starts + 1, ends - self.overlap)

    def emitted(self, starts, ends):
        """Whether a window holds anything but spaces."""
        import numpy as np

        top = len(self.dark) - 1
        return self.dark[np.minimum(ends, top)] > self.dark[np.minimum(starts, top)]

    def table(self, entries: int):
        """(entry of the next block, chunks of this one) for each entry in 0 .. entries - 1."""
        import numpy as np

        starts = np.arange(self.length, dtype=np.int64)
        ends = self.ends(starts)
        to, chunks = self.step(starts, ends), self.emitted(starts, ends).astype(np.int64)
        while True:
            inside = np.flatnonzero(to < self.length)
            if not len(inside):
                break
            # all at once from the old state: jumps double
            chunks_on, to_on = chunks[to[inside]], to[to[inside]]
            chunks[inside] += chunks_on
            to[inside] = to_on
        beyond = np.arange(min(entries, self.length), entries, dtype=np.int64)  # the block is skipped
        return (np.concatenate([to[:entries], beyond]) - self.length,
                np.concatenate([chunks[:entries], np.zeros(len(beyond), dtype=np.int64)]))

    def walk(self, entry: int) -> Iterator[tuple[int, int]]:
        """(start, end) of the windows that start in the block, from its entry on."""
        after, start = self.after.tolist(), entry
        while start < min(self.length, self.rest):
            end = start + self.size
            if end < self.rest:
                k = bisect_right(after, min(end + BOUNDARY_LOOKAHEAD, self.rest)) - 1
                if k >= 0 and after[k] > max(end - BOUNDARY_LOOKBACK, start, start + self.size // 2):
                    end = after[k]
            yield start, end
            start = max(start + 1, end - self.overlap)


def _blocks(df: DataFrame, text_col: str, keep: list[str], size: int, block_chars: int) -> DataFrame:
    """Stored (rid, block, first, length, total, part, kept): the cleaned texts in blocks."""
    ahead = size + BOUNDARY_LOOKAHEAD

    def cut(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows, held = [], 0

            def flush(rows=rows, batch=batch, kinds=kinds):
                at, *numbers, parts = zip(*rows, strict=True)
                at = pa.array(at, pa.int64())
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), *(pa.array(c, k) for c, k in zip(numbers, kinds, strict=True)),
                     pa.array(parts, batch.schema.field(1).type), batch.column(2).take(at)], ["rid", "block", "first", "length", "total", "part", "kept"])
                rows.clear()
                return out

            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                total, each = len(text), batch.column(2).slice(row, 1).nbytes
                for block, first in enumerate(range(0, total, block_chars)):
                    rows.append((row, block, first, min(block_chars, total - first), total, text[first:first + block_chars + ahead]))
                    held += ROW_BYTES + len(rows[-1][-1]) + each
                    if held >= OUT_BYTES:
                        yield flush()
                        held = 0
            if rows:
                yield flush()

    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.struct(F.lit(None).cast("int").alias("none"))
    src = df.select(F.monotonically_increasing_id().alias("rid"), chunk_clean(F.col(text_col)).alias("part"), kept.alias("kept")).filter("part <> ''")
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("block", T.IntegerType()),
                           *(T.StructField(c, T.LongType()) for c in ("first", "length", "total")),
                           T.StructField("part", T.StringType()), T.StructField("kept", src.schema["kept"].dataType)])
    path = scratch_path(df.sparkSession, "blocks")
    src.mapInArrow(cut, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def entries(blocks: DataFrame, size: int, overlap: int) -> DataFrame:
    """(rid, block, entry, chunks_before) of each block of texts with more than one."""
    reach = max(1, size + BOUNDARY_LOOKAHEAD - overlap)  # an entry lies less than a step behind the block's start

    def tables(batches):
        import pyarrow as pa

        for batch in batches:
            length, total, first = (batch.column(k).to_pylist() for k in (2, 3, 4))
            found = [Block(batch.column(5)[r].as_py(), length[r], total[r] - first[r], size, overlap).table(reach) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([t[k].tobytes() for t in found], pa.binary()) for k in (0, 1))],
                                             ["rid", "block", "to", "chunks"])

    def follow(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("block")
        entry = before = 0
        rows = []
        for rid, block, to, chunks in zip(pdf["rid"], pdf["block"], pdf["to"], pdf["chunks"], strict=True):
            rows.append((rid, block, entry, before))
            before += int(np.frombuffer(chunks, np.int64)[entry])
            entry = int(np.frombuffer(to, np.int64)[entry])
        return pd.DataFrame(rows, columns=["rid", "block", "entry", "chunks_before"])

    long = blocks.filter("total > length").select("rid", "block", "length", "total", "first", "part")
    return (long.mapInArrow(tables, "rid long, block int, to binary, chunks binary")
            .groupBy("rid").applyInPandas(follow, "rid long, block int, entry long, chunks_before long"))


def chunk_text_blocks(df: DataFrame, text_col: str = "text", size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                      keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``chunk_text``: ``keep`` columns + chunk_index, chunk_start, chunk_end, chunk."""
    if size <= 0 or block_chars <= 0:
        raise ValueError("chunk size and block length must be positive")
    keep = [c for c in (keep if keep is not None else df.columns) if c != text_col]
    ensure_on_executors(df.sparkSession)
    blocks = _blocks(df, text_col, keep, size, block_chars)
    chars = blocks.agg(F.sum("length")).first()[0] or 0
    # a task a block, up to MANY_TASKS; beyond that tasks grow with the characters, however small the blocks
    tasks = max(1, min(-(-chars // block_chars), max(MANY_TASKS, -(-chars // TASK_CHARS))))
    dealt = blocks.repartition(tasks, "rid", "block")
    found = entries(dealt, size, overlap).repartition(tasks, "rid", "block").hint("shuffle_hash")
    joined = dealt.join(found, ["rid", "block"], "left").select(
        "length", "total", "first", "part", F.coalesce("entry", F.lit(0)).alias("entry"), F.coalesce("chunks_before", F.lit(0)).alias("before"), "kept")

    def chunks(batches):
        import pyarrow as pa

        for batch in batches:
            rows, held = [], 0

            def flush(rows=rows, batch=batch):
                at, *numbers, cut = zip(*rows, strict=True)
                out = pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int32()) for c in numbers), pa.array(cut, batch.schema.field(3).type), batch.column(6).take(pa.array(at, pa.int64()))],
                    ["chunk_index", "chunk_start", "chunk_end", "chunk", "kept"])
                rows.clear()
                return out

            for r in range(batch.num_rows):
                length, total, first, part, entry, index = (batch.column(k)[r].as_py() for k in range(6))
                each = batch.column(6).slice(r, 1).nbytes
                for a, b in Block(part, length, total - first, size, overlap).walk(entry):
                    chunk = part[a:b].strip(" ")
                    if not chunk:
                        continue
                    rows.append((r, index, first + a, first + min(b, total - first), chunk))
                    index += 1
                    held += ROW_BYTES + len(chunk) + each
                    if held >= OUT_BYTES:
                        yield flush()
                        held = 0
            if rows:
                yield flush()

    schema = T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("chunk_index", "chunk_start", "chunk_end")), T.StructField("chunk", T.StringType()),
                           T.StructField("kept", blocks.schema["kept"].dataType)])
    out = joined.mapInArrow(chunks, schema)
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), "chunk_index", "chunk_start", "chunk_end", "chunk")
