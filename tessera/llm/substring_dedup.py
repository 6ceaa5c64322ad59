"""Substring dedup: repeated word windows found behind a count-min prefilter.

Pass 1 counts, per partition, the documents that hold each window's key in a
count-min sketch; Spark merges the partition sketches and keeps the cells that
reach two. The key of a window is the smallest hash of its 25-word runs
(its minimizer): equal windows have equal keys, so a sketch over keys never
estimates a window below its true count, and there is about one key for 13
windows. Pass 2 reads the texts again and exactly groups, by 96 bits of two
independent hashes, only windows whose estimate reaches two; the document with
the smallest doc_id keeps its passage. Pass 3 cuts the words covered.

The merged sketch is broadcast as bits: its size is fixed by ``width`` (two rows
of ``width`` cells, 2 * width / 8 bytes: 16 MiB by default) whatever the input. A
sketch that is too narrow for its corpus lets more windows through to pass 2 and
never changes the result. Repeats inside a batch meet there, so a passage found
in a third of all documents sends one row a batch to the shuffle.

Defined cases: null text has no words and stays null; texts shorter than a window
are untouched; a null doc_id counts as larger than any other; rows that share a
doc_id do not remove each other's words; an empty table gives an empty result;
extra columns pass through."""
from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, ship, text_blocks

WINDOW = 50
WIDTH = 1 << 26
BITMAP = 32768  # bits of one bitmap_construct_agg value
PIECE = 1 << 20
NO_ID = (1 << 63) - 1


@lru_cache(maxsize=1)
def _constants():
    """Two random byte tables and two odd bases with the powers of both."""
    import numpy as np

    rng = np.random.default_rng(20_011)
    tables = rng.integers(0, 1 << 64, size=(2, 256), dtype=np.uint64)
    bases = [int(x) | 1 for x in rng.integers(0, 1 << 63, size=2, dtype=np.uint64)]
    powers = []
    for base in bases:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(PIECE + 1, b, dtype=np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p, dtype=np.uint64))
        powers.append(pair)
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return tables, powers, space


def _mix(x):
    """Finalizer that spreads every bit of a 64-bit number over all others."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes):
    """Word starts, ends and two 64-bit hashes of every word of a byte string."""
    import numpy as np

    tables, powers, space = _constants()
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(np.concatenate([[True], space[raw], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.zeros((2, len(starts)), dtype=np.uint64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = int(np.searchsorted(ends, first + PIECE, side="right"))
        if j <= i:  # one word longer than a piece
            import xxhash

            word = data[first:ends[i]]
            hashes[:, i] = xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)
            i += 1
            continue
        part, a, b = raw[first:ends[j - 1]], starts[i:j] - first, ends[i:j] - first
        for k in (0, 1):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tables[k][part] * powers[k][0][:len(part)], dtype=np.uint64)])
            hashes[k, i:j] = _mix((total[b] - total[a]) * powers[k][1][a])
        i = j
    return starts, ends, hashes


def run_hashes(words, length: int, k: int):
    """Hash of every run of ``length`` consecutive words."""
    import numpy as np

    powers, out = _constants()[1][k], []
    step = PIECE // 2
    for s in range(0, len(words) - length + 1, step):
        part = words[s:s + step + length - 1]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * powers[0][:len(part)], dtype=np.uint64)])
        n = len(part) - length + 1
        out.append(_mix((total[length:] - total[:n]) * powers[1][:n]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _sliding_min(x, size: int):
    import numpy as np

    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:len(x) - (size - have)], x[size - have:]) if size > have else x


class Block:
    """The windows of some texts: per window the text's number, the position in
    the block, two hashes and the key."""

    def __init__(self, texts: list[bytes | None], window: int, keys: bool = True):
        import numpy as np

        data = b" ".join(t or b"" for t in texts)
        sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        self.text_ends = np.cumsum(sizes + 1) - 1
        self.starts, self.ends, self.hashes = word_hashes(data)
        self.word_ends = np.searchsorted(self.starts, self.text_ends)  # words up to the end of each text
        self.word_counts = np.diff(self.word_ends, prepend=0)
        text = np.repeat(np.arange(len(texts)), self.word_counts)
        n = max(0, len(self.starts) - window + 1)
        inside = text[:n] == text[window - 1:] if n else np.zeros(0, dtype=bool)
        self.at = np.flatnonzero(inside)
        self.text = text[self.at]
        self.window = window
        if keys and n:
            grams = run_hashes(self.hashes[0], window // 2, 0)
            self.key = _sliding_min(grams, window - window // 2 + 1)[self.at]
        else:
            self.key = np.zeros(0, dtype=np.uint64)

    def windows(self, at, k: int):
        """Hash k of the windows that start at words ``at``."""
        return run_hashes(self.hashes[k], self.window, k)[at] if len(at) else self.key[:0]


def _cells(key, width: int):
    import numpy as np

    mask = np.uint64(width - 1)
    return (key & mask).astype(np.int64), ((key >> np.uint64(32)) & mask).astype(np.int64) + width


def repeated_cells(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """Pass 1: the cells of the merged sketch that reach two, as bitmaps
    (block, bits). Counts in a partition stop at two, where merging loses nothing."""
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, cells = batch.column(0), []
            for i, j in text_blocks(_lengths_only(texts)):
                block = Block([t.as_py() for t in texts[i:j]], window)
                if not len(block.key):
                    continue
                new = np.ones(len(block.key), dtype=bool)  # a key counts once a text
                new[1:] = (block.key[1:] != block.key[:-1]) | (block.text[1:] != block.text[:-1])
                key, text = block.key[new], block.text[new]
                order = np.lexsort((key, text))
                key, text = key[order], text[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                cells += _cells(key[new], width)
            cell, n = np.unique(np.concatenate(cells) if cells else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int32))], ["cell", "n"])

    sketch = ship(docs).select(F.col("text").cast("binary")).mapInArrow(counted, "cell int, n int")
    reached = sketch.groupBy("cell").agg(F.sum("n").alias("n")).filter("n >= 2")
    return reached.groupBy(F.expr(f"cell div {BITMAP}").alias("block")).agg(
        F.expr(f"bitmap_construct_agg(cell % {BITMAP})").alias("bits"))


class _Sized:
    """A stand-in for a text of which only the length is asked."""

    def __init__(self, n):
        self.n = n

    def __len__(self):
        return self.n


def _lengths_only(column):
    import pyarrow.compute as pc

    return [_Sized(n or 0) for n in pc.binary_length(column).to_pylist()]


def duplicate_windows(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """Pass 2: (doc_id, window hash) of every window that also starts in a
    document with a smaller doc_id; a null doc_id appears as the largest long."""
    spark = docs.sparkSession
    sketch = bytearray(2 * width // 8)
    for row in repeated_cells(docs, window, width).toLocalIterator():  # 2 * width / 8 bytes at most
        at = row["block"] * BITMAP // 8
        sketch[at:at + BITMAP // 8] = row["bits"][:len(sketch) - at]
    shared = spark.sparkContext.broadcast(bytes(sketch))

    def candidates(batches):
        import numpy as np
        import pyarrow as pa

        bits = np.frombuffer(shared.value, dtype=np.uint8)

        def reached(cell):
            return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids, texts = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1)
            found = []
            for i, j in text_blocks(_lengths_only(texts)):
                block = Block([t.as_py() for t in texts[i:j]], window)
                first, second = _cells(block.key, width)
                hit = np.flatnonzero(reached(first) & reached(second))
                at = block.at[hit]
                found.append((block.windows(at, 0), block.windows(at, 1) >> np.uint64(32), ids[i + block.text[hit]]))
            w1, w2, doc = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
            order = np.lexsort((doc, w2, w1))
            w1, w2, doc = w1[order], w2[order], doc[order]
            head, new = np.ones(len(w1), dtype=bool), np.ones(len(w1), dtype=bool)
            head[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            new[1:] = head[1:] | (doc[1:] != doc[:-1])  # a window once a document
            known = ~head & (doc != doc[np.maximum.accumulate(np.where(head, np.arange(len(w1)), 0))])
            w1, w2, doc, known = w1[new], w2[new], doc[new], known[new]
            yield pa.RecordBatch.from_arrays(
                [pa.array(known), pa.array(w1.view(np.int64)), pa.array(w2.astype(np.uint32).view(np.int32)), pa.array(doc)],
                ["known", "w1", "w2", "doc"])

    rows = ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        candidates, "known boolean, w1 long, w2 int, doc long")
    # rows known from their own batch need no group: they are dealt by document
    least = F.min("doc").over(Window.partitionBy(F.when(F.col("known"), F.col("doc")), "w1", "w2")
                              .orderBy("doc").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("least", least).filter("known or doc > least").select("doc", "w1")


def drop_repeats(docs: DataFrame, window: int = WINDOW, width: int = WIDTH) -> DataFrame:
    """All rows and columns of docs; from ``text`` every word is cut that a window
    covers whose word sequence also starts in a document with a smaller doc_id
    (judged on the input). White space before a kept word stays. Adds n_words
    and n_removed (prefixed by ``_`` should docs have such columns)."""
    doc, hits, raw, n_words, n_removed = free_name(docs, "doc", "hits", "raw", "n_words", "n_removed")
    found = duplicate_windows(docs, window, width).groupBy(F.col("doc").alias(doc)).agg(F.collect_set("w1").alias(hits))
    joined = (docs.withColumn(raw, F.col("text").cast("binary"))
              .withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
              .join(found, doc, "left"))
    others = [c for c in docs.columns if c != "text"]

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts, marks = batch.column(0), batch.column(1)
            out, words, removed = [], [], []
            for i, j in text_blocks(_lengths_only(texts)):
                block_texts = [t.as_py() for t in texts[i:j]]
                block = Block(block_texts, window, keys=False)
                gone = np.zeros(len(block.starts) + 1, dtype=np.int64)
                own = [marks[r] for r in range(i, j)]
                if any(m.is_valid for m in own) and len(block.at):
                    w1 = block.windows(block.at, 0)
                    first = np.searchsorted(block.text, np.arange(j - i + 1))
                    for r, m in enumerate(own):
                        if m.is_valid:
                            a, b = first[r], first[r + 1]
                            hit = block.at[a:b][np.isin(w1[a:b], m.values.to_numpy().view(np.uint64))]
                            gone[hit] += 1
                            gone[hit + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                begin, word = 0, 0
                for r, text in enumerate(block_texts):
                    last = block.word_ends[r]
                    mine = gone[word:last]
                    words.append(last - word)
                    removed.append(int(mine.sum()))
                    if text is not None and mine.any():
                        # a kept word keeps the white space before it; what follows the last word stays
                        edges = np.concatenate([[begin], block.ends[word:last], [begin + len(text)]]) - begin
                        turn = np.diff(np.concatenate([[0], ~mine, [True, 0]]).astype(np.int8))
                        text = b"" if mine.all() else b"".join(
                            text[a:b] for a, b in zip(edges[np.flatnonzero(turn == 1)].tolist(), edges[np.flatnonzero(turn == -1)].tolist(), strict=True))
                    out.append(text)
                    begin, word = block.text_ends[r] + 1, last
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            kinds = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.large_binary() if pa.types.is_large_binary(kinds) else pa.binary()),
                 pa.array(words, pa.int64()), pa.array(removed, pa.int64()), *rest],
                [raw, n_words, n_removed, *batch.schema.names[2:]])

    fields = {f.name: f for f in docs.schema}
    schema = ", ".join([f"`{raw}` binary", f"`{n_words}` long", f"`{n_removed}` long",
                        *(f"`{c}` {fields[c].dataType.simpleString()}" for c in others)])
    done = ship(joined).select(raw, hits, *others).mapInArrow(cut, schema)
    return done.select(*(F.col(raw).cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns), n_words, n_removed)
