"""SimHash near-duplicates by a self-join of a binary trie.

Every whole text gets a 64-bit SimHash of its word shingles. Equal fingerprints
are one leaf of the trie, so a group of copies counts once. The join walks pairs
of trie nodes downwards together, starting with the root and itself: a pair's
differing bits add up on the way, and a pair over the error budget is dropped
with all below it. Spark does the upper levels as joins of node tables, four bits
a step, until both nodes of a pair are small; such pairs are dealt out, and each
task walks its small subtries bit by bit. Links inside a task shrink to a
spanning forest before they are shuffled; components follow by stars.

Defined cases: null or blank text has fingerprint 0, linked like any other; texts
of fewer words than a shingle are one shingle; a bit set in exactly half the shingles is 0; a very
long text is read in blocks by one task; repeated shingles count each;
repeated rows come out each; a null doc_id is in its component but never names
it; an empty table gives an empty result; extra columns are ignored."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batches, free_name, ship, stage
from tessera.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
STEP = 4
LEAF = 512
SEED = 42
BATCH_BYTES = 1 << 22  # of an Arrow batch of texts


def simhash(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one UTF-8 text; a bit is set if it is set in
    over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    words = text.lower().split() if text else []  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    total, ones = len(words) - shingle + 1, np.zeros(64, dtype=np.int64)
    for i in range(0, total, 1 << 16):
        part = words[i:min(len(words), i + (1 << 16) + shingle - 1)]
        line = b" ".join(part)
        sizes = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
        ends = np.cumsum(sizes + 1) - 1
        first, last = (ends - sizes)[:len(part) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(first, last, strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # sums of 255 rows fit a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _printed(slim: DataFrame, shingle: int) -> DataFrame:
    """Longs and, last, a binary text -> the longs and fp."""
    names = slim.columns[:-1]

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [simhash(t.as_py(), shingle) for t in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x - (x >> 63 << 64) for x in fps], pa.int64())], [*names, "fp"])

    return ship(slim).mapInArrow(hashed, ", ".join(f"`{c}` long" for c in [*names, "fp"]))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""
    return _printed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), shingle)


def _split(values, lo, hi, bit):
    """Where, in each sorted range [lo, hi) whose higher bits agree, ``bit`` turns to one."""
    import numpy as np

    lo, hi = lo.copy(), hi.copy()
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        one = (values[mid] >> bit[open_].astype(np.uint64)) & np.uint64(1) == 1
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1
    return lo


def walk_pairs(depth, left, right, radius: int, direct: int = 16):
    """Links (two arrays) between pairs of sorted uint64 arrays, each the leaves
    below a trie node at ``depth``: the pairs are walked together, level by
    level; node pairs with few leaf pairs are compared directly. A node paired
    with itself yields each link once."""
    import numpy as np

    a, b = np.concatenate(left), np.concatenate(right)
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    ahi, bhi = np.cumsum(na), np.cumsum(nb)
    alo, blo = ahi - na, bhi - nb
    bit = 63 - np.asarray(depth, dtype=np.int64)
    same = np.array([x[0] == y[0] and len(x) == len(y) for x, y in zip(left, right, strict=True)])
    err = np.zeros(len(bit), dtype=np.int64)
    above = bit < 63
    err[above] = np.bitwise_count((a[alo[above]] ^ b[blo[above]]) >> (bit[above] + 1).astype(np.uint64))
    err[~above] = 0
    found_a, found_b = [], []
    while len(bit):
        done = ((ahi - alo) * (bhi - blo) <= direct) | (bit < 0)
        if done.any():
            i = np.flatnonzero(done)
            wa, wb = ahi[i] - alo[i], bhi[i] - blo[i]
            each = np.repeat(i, wa * wb)
            k = np.arange(len(each)) - np.repeat(np.cumsum(wa * wb) - wa * wb, wa * wb)
            x, y = a[alo[each] + k // (bhi - blo)[each]], b[blo[each] + k % (bhi - blo)[each]]
            hit = (np.bitwise_count(x ^ y) <= radius) & (x != y) & (~same[each] | (x < y))
            found_a.append(x[hit])
            found_b.append(y[hit])
        on = ~done
        alo, ahi, blo, bhi, bit, err, same = (v[on] for v in (alo, ahi, blo, bhi, bit, err, same))
        if not len(bit):
            break
        am, bm = _split(a, alo, ahi, bit), _split(b, blo, bhi, bit)
        kids = ((alo, am, blo, bm, err, same), (am, ahi, bm, bhi, err, same),
                (alo, am, bm, bhi, err + 1, same & False), (am, ahi, blo, bm, err + 1, same & False))
        keep = [(k[0] < k[1]) & (k[2] < k[3]) & (k[4] <= radius) for k in kids]
        keep[3] &= ~same  # its mirror image is there
        alo, ahi, blo, bhi, err, same = (np.concatenate([k[n][m] for k, m in zip(kids, keep, strict=True)]) for n in range(6))
        bit = np.concatenate([bit[m] for m in keep]) - 1
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (empty, empty)


def spanning_forest(a, b):
    """As few links as keep the same components together: (node, smallest node)."""
    import numpy as np

    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at, n = at.reshape(-1), len(a)
    label = np.arange(len(nodes))
    while (label[at[:n]] != label[at[n:]]).any():
        low = np.minimum(label[at[:n]], label[at[n:]])
        np.minimum.at(label, label[at[:n]], low)
        np.minimum.at(label, label[at[n:]], low)
        np.minimum.at(label, at[:n], low)
        np.minimum.at(label, at[n:], low)
        label = label[label]
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def trie_links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """prints(fp: distinct longs) -> links a, b that join exactly the fingerprints
    reachable through steps of at most ``radius`` differing bits."""
    def prefix(depth: int):
        return F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")

    pairs, small = None, []
    for depth in range(STEP, 65, STEP):
        nodes = prints.groupBy(prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        nodes = nodes.withColumn("parent", F.shiftrightunsigned("node", STEP))
        if pairs is None:  # the root with itself
            pairs = nodes.select(F.col("parent").alias("u"), F.col("parent").alias("v"), F.lit(0).alias("err")).distinct()
        left, right = nodes.toDF("cu", "nu", "u"), nodes.toDF("cv", "nv", "v")
        below = (pairs.join(left, "u").join(right, "v")
                 .withColumn("err", F.col("err") + F.bit_count(F.col("cu").bitwiseXOR(F.col("cv")).bitwiseAND((1 << STEP) - 1)))
                 .filter((F.col("err") <= radius) & ((F.col("u") != F.col("v")) | (F.col("cu") <= F.col("cv"))))
                 .select(F.col("cu").alias("u"), F.col("cv").alias("v"), "err",
                         (F.greatest("nu", "nv") > leaf).alias("large")))
        below = stage(below, "trie")
        ready = below.filter("not large")
        ends = ready.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        leaves = (prints.withColumn("node", prefix(depth)).join(ends, "node", "left_semi")
                  .groupBy("node").agg(F.sort_array(F.collect_list("fp")).alias("leaves")))
        small.append(ready.join(leaves.toDF("u", "left"), "u").join(leaves.toDF("v", "right"), "v")
                     .select(F.lit(depth).alias("depth"), "left", "right"))
        pairs = below.filter("large").drop("large")
        if pairs.isEmpty():
            break

    def walked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            depth = batch.column(0).to_numpy()
            sides = []
            for c in (1, 2):
                flat, off = batch.column(c).flatten().to_numpy().view(np.uint64), batch.column(c).offsets.to_numpy()
                off = off - off[0] if len(off) else off
                sides.append([np.sort(flat[off[i]:off[i + 1]]) for i in range(len(depth))])
            size, start = 0, 0
            for i in range(len(depth)):
                size += len(sides[0][i]) + len(sides[1][i])
                if size > 20_000 or i == len(depth) - 1:
                    a, b = spanning_forest(*walk_pairs(depth[start:i + 1], sides[0][start:i + 1], sides[1][start:i + 1], radius))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
                    size, start = 0, i + 1

    return ship(reduce(DataFrame.unionAll, small)).mapInArrow(walked, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id of all
    documents reachable through links)."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        prints = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(trie_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(placed.join(names, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The documents without near-duplicates: of each component one row stays, the one with
    the smallest doc_id and of several such rows the one with the least text. Rows without a
    doc_id link like others and are reduced alike, one of each component, apart from the named."""
    id_, mark, mark_2, root, few, salt, nth, *same_keys = free_name(docs, "id", "mark", "mark_2", "root", "few", "salt", "nth", "k0", "k1", "k2")
    text = F.coalesce("text", F.lit(""))
    marked = docs.withColumns({id_: F.col("doc_id").cast("long"), mark: F.xxhash64(text), mark_2: F.xxhash64(F.lit(1), text)})
    keys = [id_, mark, mark_2]
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        prints = stage(_printed(marked.select(*keys, F.col("text").cast("binary").alias("text")), shingle), "fingerprints")
    roots = connected_components(trie_links(stage(prints.select("fp").distinct(), "distinct"), radius)).toDF("fp", root)
    placed = stage(prints.join(roots, "fp", "left").withColumn(root, F.coalesce(root, "fp")).groupBy(*keys, root).agg(F.count("*").alias("n")), "placed")
    # named rows and rows without a doc_id each have a least one
    least = placed.groupBy(root, F.col(id_).isNull().alias("unnamed")).agg(F.min(id_).alias("least"))
    first = placed.withColumn("unnamed", F.col(id_).isNull()).join(least, [root, "unnamed"]).filter(F.col(id_).eqNullSafe(F.col("least")))
    alone = first.groupBy(root, "unnamed").agg((F.sum("n") == 1).alias(few))
    first = stage(first.join(alone, [root, "unnamed"]).select(*(F.col(k).alias(s) for k, s in zip(keys, same_keys, strict=True)), root, few), "first")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(s)) for k, s in zip(keys, same_keys, strict=True)))
    single = marked.join(first.filter(few), same, "left_semi")
    rest = marked.join(first.filter(~F.col(few)).drop(few), same).withColumn(salt, F.monotonically_increasing_id() % 64)
    unnamed = F.col(id_).isNull()
    for part in ([root, unnamed, salt], [root, unnamed]):  # a group of many equal rows is first reduced in parts
        rest = rest.withColumn(nth, F.row_number().over(Window.partitionBy(*part).orderBy("text"))).filter(F.col(nth) == 1).drop(nth)
    return single.select(docs.columns).unionAll(rest.select(docs.columns))
