"""Exact top-k that leaves out what cannot reach the first k: pivots and the triangle inequality.

Every unit vector belongs to its nearest pivot, and blocks of vectors hold one pivot's only. The angle
between a query and a vector is at least the angle between their pivots less both blocks' radii (the
largest angle to the pivot), so a pair of blocks has an upper bound for its scores. Queries meet their own pivot's
corpus blocks first; the k-th score that the worst query of a block finds there is a floor,
and the grid of all pairs of blocks skips every pair whose bound lies under the floor, or under the k-th score
found so far in its cell, where blocks come by falling bound. Scores, ties and ranks are those of
``search.top_k``; only work is saved, most where vectors lie in clusters, none where they lie
all about as far apart.

The grid has rows of query blocks and columns of corpus blocks; either side is copied along its
own axis alone, and a cell holds at most about ``CELL_BYTES`` of each (never under ``CELL_BLOCKS`` blocks): copies are
``GRID_SIDE`` a vector until the input outgrows that many cells a side, and one more for each further ``CELL_BYTES``. Pivots (``PIVOTS`` vectors, the first by a hash of
their ids) go through the driver and are broadcast.

Defined cases: as in ``search.top_k``; corpus vectors that repeat are found each; with fewer corpus
vectors than k all are found; an empty side gives an empty result."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.search import BLOCK_ROWS, CELL_BLOCKS, DEFAULT_TOP_K, _batch_candidates
from tessera.session import ensure_on_executors, scratch_path

PIVOTS = 256
CELL_BYTES = 1 << 24  # of vectors of a side that one cell of the grid holds
GRID_SIDE = 8  # cells of a side at least, so all tasks have some
SLACK = 1e-9  # angles are rounded: a bound is widened by so much


def _unit(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(i, v): vectors that have a direction, as unit vectors of doubles."""
    usable = vectors.select(F.col(id_col).alias("i"), F.transform(vec_col, lambda x: x.cast("double")).alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    return usable.select("i", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))).alias("v"))


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pivots_of(corpus: DataFrame, n: int) -> np.ndarray:
    """At most ``n`` distinct unit vectors of corpus (i, v), the first by a hash of their ids."""
    rows = corpus.orderBy(F.xxhash64("i"), "i").limit(n).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=float), axis=0) if rows else np.zeros((0, 0))


def _blocks(vectors: DataFrame, pivots: np.ndarray, block_rows: int, name: str) -> DataFrame:
    """Stored blocks (pivot, block, radius, ids, vectors): at most about block_rows vectors of one pivot each."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["v"])
            if v.shape[1] != shared.value.shape[1]:
                raise ValueError(f"vectors have {v.shape[1]} dimensions, those of the corpus {shared.value.shape[1]}")
            cos = v @ shared.value.T
            pivot = cos.argmax(axis=1)
            yield pdf.assign(pivot=pivot.astype("int32"), angle=np.arccos(np.clip(cos[np.arange(len(v)), pivot], -1, 1)))

    kind = vectors.schema["i"].dataType.simpleString()
    near = _stored(vectors.mapInPandas(assign, f"i {kind}, v array<double>, pivot int, angle double"), f"{name}-assigned")
    # pivots with many vectors have several blocks; one count a pivot is broadcast
    counts = near.groupBy("pivot").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / block_rows).cast("int")
    salted = near.join(F.broadcast(counts), "pivot").withColumn("part", F.pmod(F.xxhash64("i"), parts).cast("int"))
    packed = salted.groupBy("pivot", "part").agg(F.max("angle").alias("radius"), F.sort_array(F.collect_list(F.struct("i", "v")), asc=False).alias("r"))
    return _stored(packed.select("pivot", F.xxhash64("pivot", "part").alias("block"), "radius", F.col("r.i").alias("ids"), F.col("r.v").alias("vectors")), f"{name}-blocks")


def _first(score: np.ndarray, ids: np.ndarray, k: int):
    """The k first of each row: score falling, then id falling."""
    order = np.argsort(ids, axis=1, kind="stable")[:, ::-1]
    order = np.take_along_axis(order, np.argsort(-np.take_along_axis(score, order, axis=1), axis=1, kind="stable")[:, :k], axis=1)
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _best(q, c, k: int, bounds, floor: float):
    """(scores, ids, floor, skipped) of one query block (ids, matrix) against corpus blocks by falling bound: the k best of each query."""
    order = np.argsort(-np.asarray(bounds), kind="stable")
    score, ids, skipped = None, None, 0
    for n in order:
        c_ids, matrix = c[n]
        if bounds[n] < floor:
            skipped += 1
            continue
        s, place = _batch_candidates(q[1] @ matrix.T, np.arange(len(matrix))[::-1], min(k, len(matrix)))
        found = np.asarray(c_ids)[len(matrix) - 1 - place]
        score = s if score is None else np.concatenate([score, s], axis=1)
        ids = found if ids is None else np.concatenate([ids, found], axis=1)
        if score.shape[1] > k:
            score, ids = _first(score, ids, k)
        if score.shape[1] >= k:  # the worst query's k-th score so far
            floor = max(floor, float(np.partition(score, -k, axis=1)[:, -k].min()) - SLACK)
    return score, ids, floor, skipped


def _cells(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int, kinds: list[str], id_col: str) -> DataFrame:
    """FOUND rows of every cell: (query_id, id, score), and one row of (pairs, skipped, floor) for each query block."""
    shared = queries.sparkSession.sparkContext.broadcast(pivots)

    def cell(left, right):
        c = [(r.ids, np.stack(r.vectors)) for r in right.itertuples()]
        out = []
        for r in left.itertuples() if len(right) else ():
            between = np.arccos(np.clip(shared.value[right["pivot"]] @ shared.value[r.pivot], -1, 1))
            bounds = np.cos(np.maximum(0.0, between - r.radius - right["radius"].to_numpy())) + SLACK
            score, ids, floor, skipped = _best((r.ids, np.stack(r.vectors)), c, k, bounds, r.floor)
            width = 0 if score is None else score.shape[1]
            out.append(pd.DataFrame({"query_id": np.repeat(np.asarray(r.ids), width) if width else [], id_col: ids.reshape(-1) if width else [],
                                     "score": score.reshape(-1) if width else [], "block": None, "pairs": None, "skipped": None, "floor": None}))
            out.append(pd.DataFrame({"query_id": [None], id_col: [None], "score": [None], "block": [r.block], "pairs": [len(c)], "skipped": [skipped],
                                     "floor": [floor if width >= k else -2.0]}))
        names = ["query_id", id_col, "score", "block", "pairs", "skipped", "floor"]
        return pd.concat([x for x in out if len(x)], ignore_index=True)[names].astype(object) if out else pd.DataFrame(columns=names)

    schema = f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, score double, block long, pairs long, skipped long, floor double"
    return queries.groupBy("row", "col").cogroup(corpus.groupBy("row", "col")).applyInPandas(cell, schema)


def top_k_pruned(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_TOP_K, id_col: str = "vec_id", vec_col: str = "embedding",
                 query_id_col: str | None = None, block_rows: int = BLOCK_ROWS, pivots: int = PIVOTS, cell_blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(result, saved): result as ``search.top_k``'s (query_id, rank, id, score); saved one row (pairs, skipped, share) of
    block pairs that the grid left out."""
    spark = queries.sparkSession
    ensure_on_executors(spark)
    qid = query_id_col or id_col
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, qid), (corpus, id_col))]
    c_unit = _unit(corpus, id_col, vec_col)
    points = pivots_of(c_unit, pivots)
    if not len(points):
        empty = spark.createDataFrame([], f"query_id {kinds[0]}, rank int, `{id_col}` {kinds[1]}, score double")
        return empty, spark.sql("select 0L as pairs, 0L as skipped, 0.0D as share")
    qs = _blocks(_unit(queries, qid, vec_col), points, block_rows, "queries")
    cs = _blocks(c_unit, points, block_rows, "corpus")
    # home round: a pivot's query blocks against its corpus blocks (a few) give the floors
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("block"))
    homes = cs.withColumn("n", rank).filter(F.col("n") <= (cell_blocks or CELL_BLOCKS)).drop("n")
    home = _stored(_cells(qs.select("*", F.lit(-2.0).alias("floor"), F.col("pivot").alias("row"), F.col("block").alias("col")),
                          homes.join(qs.select("pivot", F.col("block").alias("col")), "pivot").select(*cs.columns, F.col("pivot").alias("row"), "col"),
                          points, k, kinds, id_col), "home")
    floors = home.filter("block is not null").select("block", "floor")
    n_q, n_c = qs.count(), cs.count()
    held = cell_blocks or max(CELL_BLOCKS, CELL_BYTES // (8 * points.shape[1] * block_rows))
    rows, cols = (max(1, -(-n // held), min(n, GRID_SIDE)) for n in (n_q, n_c))
    every_q = qs.join(floors, "block", "left").fillna(-2.0, ["floor"])
    q_sent = every_q.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(rows)).cast("int")).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    c_sent = cs.withColumn("col", F.pmod(F.xxhash64("block"), F.lit(cols)).cast("int")).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    found = _stored(_cells(q_sent, c_sent, points, k, kinds, id_col), "found")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(id_col))
    ranked = found.filter("block is null").withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
    saved = found.filter("block is not null").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"))
    return (ranked.select("query_id", "rank", id_col, "score"),
            saved.withColumn("share", F.when(F.col("pairs") > 0, F.col("skipped") / F.col("pairs")).otherwise(0.0)))
