"""Sharding over fixed virtual slots.

A record's slot is a hash of its doc_id and text checksum (and, where rows repeat both, of a
number below their count), modulo a fixed number of slots (4096). Bytes are aggregated per slot, and a stored, versioned map says
which shard a slot belongs to. The first version deals slots out by falling size,
each to the shard with the fewest bytes; ``rebalanced`` moves as few slots as bring
the sizes close again; ``grown`` moves slots only into an added shard. Records
never move but with their slot. The law kept is ``bytes``: sizes nearly equal, as
far as single records allow.

Only SQL functions; the map's fixed number of rows is all the driver sees.
Defined cases: null text has no bytes and checksum 0; a null doc_id is hashed by
its text alone; rows that repeat doc_id and text are spread over the slots and are numbered
apart; a very long text is one record, which no shard splits; slots of equal size go by number,
to the first of the shards with equal bytes that has the fewest slots; an empty table
gives an empty result; extra columns are ignored."""
from __future__ import annotations

import heapq
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.session import scratch_path

SLOTS = 4096
STRIPES = 64  # a slot's records are numbered in so many parts


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, stripe for each row. Rows that repeat doc_id and checksum
    also hash a stored random number below their count, so that they spread over slots."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                             F.xxhash64(F.monotonically_increasing_id()).alias("u")), "rows")
    often = rows.groupBy(F.col("doc_id").alias("same_id"), F.col("text_crc32").alias("same_crc")).agg(F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(often, F.col("doc_id").eqNullSafe(F.col("same_id")) & (F.col("text_crc32") == F.col("same_crc")), "left")
    place = F.when(F.col("n").isNull(), F.xxhash64("doc_id", "text_crc32")).otherwise(F.xxhash64("doc_id", "text_crc32", F.pmod("u", "n")))
    return joined.select("doc_id", "size", "text_crc32", F.pmod(place, F.lit(slots)).cast("int").alias("virtual_slot"),
                         F.pmod("u", F.lit(STRIPES)).cast("int").alias("stripe"))


def slot_bytes(recs: DataFrame) -> dict[int, int]:
    """Bytes per slot: at most the fixed number of slots."""
    return {r["virtual_slot"]: r["size"] for r in recs.groupBy("virtual_slot").agg(F.sum("size").alias("size")).collect()}


def first_map(sizes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slots by falling bytes, each to the shard with the fewest bytes so far."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        load, n, shard = heap[0]
        out[slot] = shard
        heapq.heapreplace(heap, (load + sizes.get(slot, 0), n + 1, shard))
    return out


def _loads(mapping, sizes, shards):
    loads = [0] * shards
    for slot, shard in mapping.items():
        loads[shard] += sizes.get(slot, 0)
    return loads


def rebalanced(mapping: dict[int, int], sizes: dict[int, int], shards: int, slack: float = 0.02) -> dict[int, int]:
    """An edited map: while the fullest shard is over the mean by more than
    ``slack``, its largest slot that narrows the gap moves to the emptiest."""
    out, loads = dict(mapping), _loads(mapping, sizes, shards)
    mean = sum(loads) / shards
    while max(loads) > mean * (1 + slack):
        full, least = loads.index(max(loads)), loads.index(min(loads))
        gap = loads[full] - loads[least]
        fits = [s for s, h in out.items() if h == full and 0 < sizes.get(s, 0) < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(sizes[s] - gap / 2), s))
        out[slot] = least
        loads[full] -= sizes[slot]
        loads[least] += sizes[slot]
    return out


def grown(mapping: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """An edited map for one more shard: it takes slots from the fullest in turn
    until it has its share; no other shard gains any."""
    out, loads = dict(mapping), [*_loads(mapping, sizes, shards), 0]
    share = sum(loads) / (shards + 1)
    while True:
        full = max(range(shards), key=lambda s: (loads[s], -s))
        fits = [s for s, h in out.items() if h == full and 0 < sizes.get(s, 0) <= share - loads[shards]]
        if loads[full] <= share or not fits:
            return out
        slot = max(fits, key=lambda s: (-abs(sizes[s] - (loads[full] - share)), -s))
        out[slot] = shards
        loads[full] -= sizes[slot]
        loads[shards] += sizes[slot]


def map_rows(spark: SparkSession, mapping: dict[int, int], version: int) -> DataFrame:
    """(version, virtual_slot, shard) rows of a map."""
    listed = F.from_json(F.lit(json.dumps([mapping[s] for s in range(len(mapping))])), "array<int>")
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(listed).alias("virtual_slot", "shard"))


def store_map(spark: SparkSession, path: str, mapping: dict[int, int], version: int) -> None:
    """Add a version to a stored map; earlier versions stay."""
    map_rows(spark, mapping, version).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> dict[int, int]:
    """A stored version of the map, the latest by default."""
    rows = spark.read.parquet(path)
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    return {r["virtual_slot"]: r["shard"] for r in rows.filter(F.col("version") == version).collect()}


def place(recs: DataFrame, mapping: dict[int, int], version: int = 1) -> DataFrame:
    """Add shard and slot (the record's place in its shard, gapless from 0) to
    stored records. Places are counted per slot and stripe, then offset by the
    counts before, so no task sees a whole shard's records."""
    shards = F.broadcast(map_rows(recs.sparkSession, mapping, version))  # one row a slot
    counts = recs.groupBy("virtual_slot", "stripe").agg(F.count("*").alias("n")).join(shards, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "stripe")
    starts = counts.withColumn("start", F.sum("n").over(before) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy("virtual_slot", "stripe").orderBy("doc_id", "text_crc32"))
    numbered = recs.withColumn("nth", nth).join(starts, ["virtual_slot", "stripe"])
    return numbered.withColumn("slot", (F.col("start") + F.col("nth") - 1).cast("long")).drop("nth", "start", "stripe")


def edited_map(spark: SparkSession, path: str, sizes: dict[int, int], shards: int, slots: int = SLOTS, earlier: str | None = None) -> int:
    """Store the next version of the map under ``path`` and return its number: the first
    one, or the latest stored under ``earlier`` grown to more shards, else rebalanced."""
    if earlier is None:
        store_map(spark, path, first_map(sizes, shards, slots), 1)
        return 1
    mapping = load_map(spark, earlier)
    version, before = spark.read.parquet(earlier).agg(F.max("version")).first()[0] + 1, max(mapping.values()) + 1
    if len(mapping) != slots or before > shards:
        raise ValueError(f"the map of {len(mapping)} slots and {before} shards cannot be edited to {slots} slots and {shards} shards")
    if before == shards:
        mapping = rebalanced(mapping, sizes, shards)
    for n in range(before, shards):
        mapping = grown(mapping, sizes, n)
    store_map(spark, path, mapping, version)
    return version


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, path: str | None = None, earlier: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: not this
    law), virtual_slot, version. The map's version is stored under ``path`` (the shared
    folder by default) and read from there; ``earlier`` is the folder of a map to edit."""
    spark = docs.sparkSession
    path = path or earlier or scratch_path(spark, "shard-map")
    recs = stage(records(docs, slots), "records")
    version = edited_map(spark, path, slot_bytes(recs), shards, slots, earlier)
    placed = place(recs, load_map(spark, path, version), version)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
