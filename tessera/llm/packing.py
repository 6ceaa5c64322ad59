"""Best-fit packing: bounded-space online best-fit over token pieces.

Documents become token ids plus an end id; longer ones are cut into full
sequences and a rest. The pieces are dealt evenly into groups of a set size, and
each group is packed by one task: a piece goes to the open bin with the least
room that still holds it. Open bins are filed by free space, and one integer
serves as a bitset of the free spaces in use, so the best bin is one shift and
one lowest-bit away. At most ``open_bins`` are open; beyond that the fullest
closes first. A group takes its pieces in falling length, which wastes less.

Defined cases: a null or blank text is the end id alone; equal rows are packed
separately; an empty table gives an empty result; extra columns are ignored; the
row number used for dealing does not depend on any column, so neither a null
nor a repeated doc_id fills one group."""
from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, stage
from tessera.llm.tokens import vocabulary_path, word_ids

LIMIT = 2048
PIECES_PER_GROUP = 1 << 15
OPEN_BINS = 1 << 13
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = 0, vocabulary: str | None = None,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece (doc_id, piece, start, length, ids_crc32; with
    ``with_ids`` also the ids themselves as little-endian unsigned 32-bit
    integers in ``ids``)."""
    path, end = vocabulary or vocabulary_path(), end_id.to_bytes(4, "little")

    def pieces(batches):
        import pyarrow as pa

        encoder = word_ids(path)
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")] + ["ids"] * with_ids
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at:at + 4 * limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[:len(names)])
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    slim = ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return slim.mapInArrow(pieces, PIECE_SCHEMA + (", ids binary" if with_ids else ""))


def best_fit(lengths, limit: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length in turn."""
    by_room: dict[int, list[int]] = {}
    used, n_open, bins = 0, 0, 0  # used: bit r is set while a bin with r free is open
    for need in lengths:
        fits = used >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            here = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
            n_open -= 1
        else:
            here, room = bins, limit
            bins += 1
        yield here, limit - room
        room -= need
        if room:
            by_room.setdefault(room, []).append(here)
            used |= 1 << room
            n_open += 1
            if n_open > open_bins:  # the fullest closes
                least = (used & -used).bit_length() - 1
                by_room[least].pop()
                if not by_room[least]:
                    used &= ~(1 << least)
                n_open -= 1


def pack(pieces: DataFrame, limit: int = LIMIT, open_bins: int = OPEN_BINS,
         pieces_per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """Add sequence_id and offset to staged pieces (columns doc_id, piece, start, length, ids_crc32)."""
    groups = max(1, -(-pieces.count() // pieces_per_group))

    def packed(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        placed = list(best_fit(pdf["length"].tolist(), limit, open_bins))
        first = int(pdf["group"].iloc[0]) << 32
        pdf["sequence_id"] = [first + b for b, _ in placed]
        pdf["offset"] = [o for _, o in placed]
        return pdf.drop(columns="group")

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return ship(dealt).groupBy("group").applyInPandas(packed, PIECE_SCHEMA + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = LIMIT, open_bins: int = OPEN_BINS,
                   vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenize once (stored in the shared folder), then pack."""
    return pack(stage(token_pieces(docs, limit, end_id, vocabulary), "pieces"), limit, open_bins)
