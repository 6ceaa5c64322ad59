"""Suffix-array dedup over bytes with a logarithmic family of indexes.

Documents come in batches of rising doc_id. A batch gets a sparse suffix array, which is
merge-scanned against the arrays of the levels before it for long matches; then it becomes
a level itself, and two levels of equal size are merged into one of double size before the
next batch comes, so a batch meets at most log2(batches) + 1 of them. The family is kept bucket
by bucket: a task takes a bucket's batches in order, so segments are shuffled once, and a lost
executor repeats its buckets from the segments stored in the shared folder.

Suffixes. Of the ``GRAM``-byte runs inside a window of ``WINDOW`` bytes, the one with the least
hash is its anchor: equal windows have equal anchors. Consecutive windows with one
anchor form a segment, and the array holds one suffix a segment, the one from its anchor, sorted
by its bytes. Segments are dealt into buckets by their anchor, so that all places where a
window occurs meet in one bucket. Where two arrays have suffixes with one anchor, their
windows are compared byte by byte; the document with the smallest doc_id keeps its own.

Prefilter. A first pass counts anchors over the whole corpus in ``CELLS`` cells; a segment
whose anchor comes once is in one document only and is left out. The cells are broadcast as
bits (``CELLS`` / 8 = 32 MiB; a sketch that is too narrow only lets more segments through).
Segments that a task has sent for a smaller doc_id (by 128 bits of hash; the last ``REMEMBERED`` or
so) are judged there, so a passage found in a third of all documents sends few rows a task. An anchor found ``HOT`` times or more (a common phrase in
ever new surroundings) is not kept together: its windows are dealt one by one, by their bytes.

Defined cases: a null text is empty and stays null in ``kept``; texts shorter than a window are
untouched; a null doc_id counts as larger than any other; rows that share a doc_id do not
remove each other's bytes; very long texts are worked on in overlapping pieces of ``PIECE`` bytes;
an empty table gives an empty result; extra columns pass through."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, free_name, ship, stage, text_blocks
from tessera.llm.substring_dedup import _sliding_min, run_hashes

WINDOW = 50
GRAM = 16
CELLS = 1 << 28
BITMAP = 1 << 16  # cells of one block
HOT = 1 << 16
PIECE = 1 << 20
REMEMBERED = 200_000  # segments that a task knows to be sent
PART = 1 << 21  # bytes of text whose segments a task holds at a time
RUN = 1024  # windows of a segment at most
BATCHES = 4
BATCH_BYTES = 1 << 22  # of an Arrow batch of texts
BUCKET_BYTES = 1 << 22  # of a batch's text for one bucket
MIN_BUCKETS = 64
NO_ID = (1 << 63) - 1
HITS = "doc long, mark long, ranges binary"


def _values():
    import numpy as np

    return np.random.default_rng(20_013).integers(0, 1 << 64, size=256, dtype=np.uint64)


def _mixed(key):
    import numpy as np

    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(32))


class Segments:
    """Segments of some texts: text number, place in it, windows, key, and place in ``data``."""

    def __init__(self, texts: list[bytes | None], window: int, gram: int):
        import numpy as np

        pieces = [(i, at, t[at:at + PIECE + window - 1]) for i, t in enumerate(texts) if t for at in range(0, max(1, len(t) - window + 1), PIECE)]
        self.data = b"".join(p for _, _, p in pieces)
        n = max(0, len(self.data) - window + 1)
        self.reach = window - gram + 1  # runs of gram bytes inside a window
        sizes = np.array([len(p) for _, _, p in pieces], dtype=np.int64)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
        inside = piece[:n] == piece[window - 1:] if n else np.zeros(0, dtype=bool)
        self.hashes = run_hashes(_values()[np.frombuffer(self.data, np.uint8)], gram, 0) if n else np.zeros(0, np.uint64)
        key = _sliding_min(self.hashes, self.reach) if n else self.hashes
        turn = np.ones(n, dtype=bool)
        turn[1:] = (key[1:] != key[:-1]) | (piece[1:n] != piece[:n - 1]) | (inside[1:] != inside[:-1])
        heads = np.flatnonzero(turn)
        turn[(np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))) % RUN == 0] = True
        heads = np.flatnonzero(turn)
        lengths = np.diff(np.append(heads, n))
        heads, lengths = heads[inside[heads]], lengths[inside[heads]]
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.zeros(0, np.int64)
        self.place, self.windows, self.key = heads, lengths, key[heads]
        self.text = np.array([i for i, _, _ in pieces], dtype=np.int64)[piece[heads]]
        self.at = np.array([a for _, a, _ in pieces], dtype=np.int64)[piece[heads]] + heads - starts[piece[heads]]


    def anchors(self, which):
        """Place of the anchor in each of these segments: that of its first window."""
        import numpy as np

        return self.hashes[self.place[which][:, None] + np.arange(self.reach)].argmin(axis=1)


def _blocks(column, limit: int) -> Iterator[tuple[int, int]]:
    import pyarrow.compute as pc

    return text_blocks([range(n or 0) for n in pc.binary_length(column).to_pylist()], limit)


def anchor_cells(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS, hot: int = HOT) -> DataFrame:
    """(block, repeated, hot): bitmaps of the cells that two documents or ``hot`` documents reach.
    Tasks send the cells of a batch of texts block by block, sorted; a block is added up row by row."""
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found = []
            for i, j in _blocks(batch.column(0), PIECE):
                s = Segments([t.as_py() for t in batch.column(0)[i:j]], window, gram)
                order = np.lexsort((s.key, s.text))
                key, text = s.key[order], s.text[order]
                new = np.ones(len(key), dtype=bool)  # an anchor counts once a text
                new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                found.append((key[new] & np.uint64(cells - 1)).astype(np.int64))
            cell, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            heads = np.flatnonzero(np.diff(cell // BITMAP, prepend=-1))
            ends = np.append(heads[1:], len(cell))
            places, counts = (cell % BITMAP).astype("<u2").tobytes(), n.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array((cell[heads] // BITMAP).astype(np.int32)), pa.array([places[2 * a:2 * b] for a, b in zip(heads, ends, strict=True)], pa.binary()),
                 pa.array([counts[4 * a:4 * b] for a, b in zip(heads, ends, strict=True)], pa.binary())], ["block", "places", "counts"])

    def added(batches):
        import numpy as np
        import pyarrow as pa

        def bitmaps(block, total):
            some = [np.packbits(total >= n, bitorder="little").tobytes() if (total >= n).any() else None for n in (2, hot)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in some)], ["block", "repeated", "hot"])

        current, total = None, np.zeros(BITMAP, dtype=np.int64)
        for batch in batches:
            for block, places, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != current:
                    if current is not None:
                        yield bitmaps(current, total)
                    current, total = block, np.zeros(BITMAP, dtype=np.int64)
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<u4")  # a place comes once a row
        if current is not None:
            yield bitmaps(current, total)

    rows = ship(docs).select(F.col("text").cast("binary")).mapInArrow(counted, "block int, places binary, counts binary")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(added, "block int, repeated binary, hot binary").filter("repeated is not null")


def pack(columns: list, texts: list[bytes]) -> bytes:
    """Columns of integers and one of bytes as one compressed value."""
    import numpy as np
    import pyarrow as pa

    head = np.array([len(texts), len(columns)], dtype="<i8").tobytes()
    body = head + b"".join(np.array(c, dtype="<i8").tobytes() for c in [*columns, list(map(len, texts))]) + b"".join(texts)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def unpack(value: bytes) -> tuple[list[list[int]], list[bytes]]:
    import numpy as np
    import pyarrow as pa

    body = pa.decompress(value[8:], decompressed_size=int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True)
    n, width = np.frombuffer(body, "<i8", 2).tolist()
    columns = np.frombuffer(body, "<i8", n * (width + 1), 16).reshape(width + 1, n)
    ends = (16 + 8 * n * (width + 1) + np.cumsum(columns[-1])).tolist()
    return columns[:-1].tolist(), [body[e - k:e] for e, k in zip(ends, columns[-1].tolist(), strict=True)]


def spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows at rising ``starts``."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + window)
        else:
            out.append((s, s + window))
    return out


def _ranges(by_row: dict) -> list:
    """doc, mark and packed ranges of {(doc, mark): [(from, to), ...]}."""
    import numpy as np
    import pyarrow as pa

    return [pa.array([d for d, _ in by_row], pa.int64()), pa.array([m for _, m in by_row], pa.int64()),
            pa.array([np.array(r, dtype="<i8").tobytes() for r in by_row.values()], pa.binary())]


def candidates(docs: DataFrame, cuts: list[int], buckets: int, window: int = WINDOW, gram: int = GRAM, cells: int = CELLS, hot: int = HOT) -> DataFrame:
    """Rows (batch, bucket, body) of segments that may repeat, and, with batch -1, rows (doc,
    mark, ranges) of what a smaller doc_id met by the same task is known to hold.
    docs: doc, mark (tells rows of one doc apart), text. ``cuts``: the doc that ends each batch but the last."""
    maps = {name: bytearray(cells // 8) for name in ("repeated", "hot")}
    for row in stage(anchor_cells(docs, window, gram, cells, hot), "cells").toLocalIterator():  # 2 * cells / 8 bytes at most
        at = row["block"] * BITMAP // 8
        for name, bits in maps.items():
            if row[name]:
                bits[at:at + BITMAP // 8] = row[name][:cells // 8 - at]
    shared = docs.sparkSession.sparkContext.broadcast((bytes(maps["repeated"]), bytes(maps["hot"]) if any(maps["hot"]) else b""))

    def segments(batches):
        from bisect import bisect_left

        import numpy as np
        import pyarrow as pa
        import xxhash

        repeated, often = (np.frombuffer(x, dtype=np.uint8) for x in shared.value)

        def reached(bits, cell):
            return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1

        def parts():
            first: dict[int, int] = {}  # 128-bit hash of a segment -> its smallest doc so far
            for batch in batches:
                for i, j in _blocks(batch.column(2), PART):
                    yield batch.slice(i, j - i), first
                    if len(first) > REMEMBERED:  # forgetting only sends more segments on
                        first.clear()

        for batch, first in parts():
            docs_, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            known: dict[tuple, list] = {}
            out: dict[tuple, list] = {}
            for i, j in _blocks(texts, PIECE):
                s = Segments([t.as_py() for t in texts[i:j]], window, gram)
                cell = (s.key & np.uint64(cells - 1)).astype(np.int64)
                hit = np.flatnonzero(reached(repeated, cell))
                split = reached(often, cell[hit]) if len(often) else np.zeros(len(hit), dtype=bool)
                dealt = (_mixed(s.key[hit]) % np.uint64(buckets)).astype(np.int64)
                columns = (s.text[hit] + i, s.at[hit], s.place[hit], s.windows[hit], s.anchors(hit), dealt, split)
                for row, at, place, n, anchor, bucket, alone in zip(*(c.tolist() for c in columns), strict=True):
                    doc = docs_[row]
                    for k in range(n) if alone else (None,):
                        if alone:
                            text, where = s.data[place + k:place + k + window], at + k
                            bucket, anchor = xxhash.xxh64_intdigest(text) % buckets, int(s.hashes[place + k:place + k + s.reach].argmin())
                        else:
                            text, where = s.data[place:place + n + window - 1], at
                        if first.setdefault(h := xxhash.xxh3_128_intdigest(text), doc) < doc:
                            ranges = known.setdefault((doc, marks[row]), [])
                            if ranges and ranges[-1][1] >= where:
                                ranges[-1] = (ranges[-1][0], where + len(text))
                            else:
                                ranges.append((where, where + len(text)))
                        else:
                            first[h] = doc
                            out.setdefault((bisect_left(cuts, doc), bucket), []).append((doc, marks[row], where, anchor, text))
            keys = sorted(out)
            rows = [list(zip(*out[k], strict=True)) for k in keys]
            names = ["batch", "bucket", "body", "doc", "mark", "ranges"]
            nothing = [pa.nulls(len(keys), t) for t in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in keys], pa.int32()), pa.array([b for _, b in keys], pa.int32()),
                                              pa.array([pack(list(r[:4]), list(r[4])) for r in rows], pa.binary()), *nothing], names)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * len(known), pa.int32()), pa.nulls(len(known), pa.int32()), pa.nulls(len(known), pa.binary()),
                                              *_ranges(known)], names)

    return ship(docs).select("doc", "mark", F.col("text").cast("binary")).mapInArrow(segments, f"batch int, bucket int, body binary, {HITS}")


def suffix_array(entries: list[tuple[bytes, int, int]]) -> list[tuple[bytes, bytes, int]]:
    """(suffix, text, doc) of (text, place of its anchor, doc) entries, sorted."""
    return sorted((text[anchor:], text, doc) for text, anchor, doc in entries)


def merge_scan(batch: list, levels: list[list], gram: int) -> Iterator[tuple[list, list]]:
    """Members of the batch and of all levels for each anchor of the batch: one walk over sorted arrays."""
    places = [0] * len(levels)
    i = 0
    while i < len(batch):
        anchor = batch[i][0][:gram]
        j = i
        while j < len(batch) and batch[j][0][:gram] == anchor:
            j += 1
        others = []
        for k, level in enumerate(levels):
            p = places[k]
            while p < len(level) and level[p][0][:gram] < anchor:
                p += 1
            while p < len(level) and level[p][0][:gram] == anchor:
                others.append(level[p])
                p += 1
            places[k] = p
        yield batch[i:j], others
        i = j


def scan_batch(bodies: list[bytes], levels: list[list], window: int, gram: int) -> tuple[dict, list]:
    """What a batch repeats of itself or of the levels, as {(doc, mark): ranges}, and its own rows for the index."""
    places: dict[bytes, list] = {}
    anchor_of: dict[bytes, int] = {}
    for b in bodies:
        (docs, marks, ats, anchors), texts = unpack(b)
        anchor_of.update(zip(texts, anchors, strict=True))
        for text, *place in zip(texts, docs, marks, ats, strict=True):
            places.setdefault(text, []).append(tuple(place))
    least = {text: min(p)[0] for text, p in places.items()}
    hits: dict[tuple, list] = {}
    fresh = []
    for members, others in merge_scan(suffix_array([(t, anchor_of[t], d) for t, d in least.items()]), levels, gram):
        if len(members) + len(others) == 1:
            fresh += members
            continue
        stored_texts = {text for _, text, _ in others}
        whole = [m for m in members if m[1] in stored_texts]
        for _, text, doc in whole:  # a level has it: nothing to compare, nothing new for the index
            for d, mark, at in places[text]:
                if d == doc:
                    hits.setdefault((d, mark), []).append((at, at + len(text)))
        members = [m for m in members if m[1] not in stored_texts] if whole else members
        holder: dict[bytes, int] = {}
        for _, text, doc in others if members else ():
            for k in range(len(text) - window + 1):
                w = text[k:k + window]
                if holder.get(w, NO_ID) >= doc:
                    holder[w] = doc
        kept = []
        for member in sorted(members, key=lambda m: m[2]):
            _, text, doc = member
            covered = [k for k in range(len(text) - window + 1) if holder.setdefault(text[k:k + window], doc) < doc]
            if len(covered) < len(text) - window + 1:
                kept.append(member)  # a segment that is covered whole adds nothing to the index
            if covered:
                for d, mark, at in places[text]:
                    if d == doc:
                        hits.setdefault((d, mark), []).extend(spans([at + k for k in covered], window))
        fresh += sorted(kept)
    for text, found in places.items():
        for d, mark, at in found:
            if d > least[text]:
                hits.setdefault((d, mark), []).append((at, at + len(text)))
    return hits, fresh


def merge_levels(a: list, b: list) -> list:
    """One level of two: sorted arrays merged, a text kept once for its smallest doc_id."""
    import heapq

    rows: list[tuple] = []
    for row in heapq.merge(a, b):
        if not rows or rows[-1][:2] != row[:2]:
            rows.append(row)
    return rows


def index_family(bodies: dict[int, list[bytes]], window: int, gram: int) -> Iterator[dict]:
    """Hits of one batch after the other, each scanned against the levels before it, then made a level itself."""
    levels: list[tuple[int, list]] = []  # (batches in it, rows), largest first
    last = max(bodies)
    for batch in sorted(bodies):
        while len(levels) > 1 and levels[-1][0] == levels[-2][0]:
            (_, b), (n, a) = levels.pop(), levels.pop()
            levels.append((2 * n, merge_levels(a, b)))
        hits, fresh = scan_batch(bodies[batch], [rows for _, rows in levels], window, gram)
        yield hits
        if batch < last:  # nothing comes after the last batch
            levels.append((1, fresh))


def scan_batches(found: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, mark, ranges) of the segments (batch, bucket, body), each bucket's batches in one task."""
    def scan(key, group):
        import pyarrow as pa

        bodies: dict[int, list] = {}
        for batch, body in zip(group["batch"].to_pylist(), group["body"].to_pylist(), strict=True):
            bodies.setdefault(batch, []).append(body)
        return pa.concat_tables([pa.table(_ranges(hits), names=["doc", "mark", "ranges"]) for hits in index_family(bodies, window, gram)])

    return ship(found).groupBy("bucket").applyInArrow(scan, HITS)


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, cells: int = CELLS, hot: int = HOT,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, mark, ranges) of docs (doc, mark, text): packed byte ranges covered by windows that
    also start in a smaller doc; several rows for one text."""
    cut = [k / batches for k in range(1, batches)]
    known = docs.agg(F.percentile_approx(F.when(F.col("doc") != NO_ID, F.col("doc")), cut, 10_000).alias("cuts"),
                     F.sum(F.octet_length("text")).alias("size")).first()
    buckets = max(MIN_BUCKETS, -(-(known["size"] or 0) // (batches * bucket_bytes)))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        found = stage(candidates(docs, sorted(set(known["cuts"] or [])), buckets, window, gram, cells, hot), "segments")
    return found.filter("batch = -1").select("doc", "mark", "ranges").unionAll(
        stage(scan_batches(found.filter("batch >= 0").select("batch", "bucket", "body"), window, gram), "ranges"))


def cut_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **sizes) -> DataFrame:
    """All rows and columns of docs with kept (binary: the bytes that are left of ``text``), n_bytes,
    n_removed and n_spans (names prefixed by ``_`` where docs have such columns). A byte goes if a
    window covers it that also starts in a document with a smaller doc_id, judged on the input."""
    doc, mark, ranges, *added = free_name(docs, "doc", "mark", "ranges", "kept", "n_bytes", "n_removed", "n_spans")
    marked = docs.withColumns({doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), mark: F.xxhash64("text")})
    found = repeated_ranges(marked.select(F.col(doc).alias("doc"), F.col(mark).alias("mark"), "text"), window, gram, **sizes)
    hits = found.groupBy(F.col("doc").alias(doc), F.col("mark").alias(mark)).agg(F.collect_list("ranges").alias(ranges))
    joined = marked.join(hits, [doc, mark], "left").select(F.col("text").cast("binary").alias("body"), ranges, *docs.columns)

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept, counts = [], []
            for text, found in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py()
                size = len(data or b"")
                if not found.is_valid:
                    kept.append(data)
                    counts.append((size, 0, 0))
                    continue
                change = np.zeros(size + 1, dtype=np.int32)
                for packed in found.as_py():
                    at = np.frombuffer(packed, "<i8").reshape(-1, 2)
                    np.add.at(change, at[:, 0], 1)
                    np.add.at(change, at[:, 1], -1)
                gone = np.cumsum(change[:-1]) > 0
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                counts.append((size, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
            sums = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            rest = [batch.column(k) for k in range(2, batch.num_columns)]
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, kind), *sums], [*batch.schema.names[2:], *added])

    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{added[0]}` binary", *(f"`{c}` long" for c in added[1:])])
    return ship(joined).mapInArrow(cut, kinds)
