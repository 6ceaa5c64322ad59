"""Exact cosine similarity and top-k search over ``array<float>`` vectors.

* ``cosine``: native expression (double precision).
* ``top_k_single``: one query vector against a corpus; ``TakeOrderedAndProject``.
* ``top_k``: many queries against a corpus without materialising pairs. Queries and
  corpus are packed into blocks of about ``BLOCK_ROWS`` vectors, and either side is shuffled once: a grid
  of tasks (a Cartesian product of the partitions) reads a partition of each, of about ``SIDE_BYTES`` of vectors at
  most. Each pair of blocks is one matrix product (numpy, Arrow batches); of a query's scores only those leave that
  reach its k-th best of the task so far, k of a block at most. The final
  ranking runs over k candidates per query and corpus partition (``WindowGroupLimit``).
  Nothing goes through the driver, and all sizes take the same way.

Ranking: score descending, then vector id descending (ids of any orderable type).
Null vectors, zero vectors and vectors with a null or NaN element have no
direction: they are neither found nor answered."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ensure_on_executors

DEFAULT_TOP_K = 5
BLOCK_ROWS = 2048
CELL_BLOCKS = 4  # blocks of a side that a cell of search_pruned's grid holds at least
SIDE_BYTES = 1 << 25  # of vectors of a side that a task of top_k reads
TASKS_PER_CORE = 4


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    """dot(a, b) / (|a| |b|); null when either vector is all zeros."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def centroid(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One row: the mean vector (per-dimension mean, partial aggregation)."""
    long_ = df.select(F.posexplode(vec_col).alias("d", "v"))
    per_dim = long_.groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return per_dim.agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "v"))), lambda x: x["v"])
                       .alias(vec_col))


def top_k_single(corpus: DataFrame, query: DataFrame, k: int = DEFAULT_TOP_K, id_col: str = "vec_id",
                 vec_col: str = "embedding") -> DataFrame:
    """Top-k of one query (a one-row frame with ``vec_col``): (rank, id, score).
    More than one query row is an error; use ``top_k`` for those. The single row is
    attached by a join on a constant (one row: bounded)."""
    one = query.select(F.col(vec_col).alias("__q")).limit(2).withColumn("__k", F.lit(1))
    if one.count() > 1:
        raise ValueError("top_k_single answers one query vector; use top_k for several")
    q = F.broadcast(one)
    scored = (corpus.select(id_col, vec_col).withColumn("__k", F.lit(1)).join(q, "__k")
              .select(id_col, cosine(vec_col, "__q").alias("score"))
              .filter(F.col("score").isNotNull()))
    top = scored.orderBy(F.desc("score"), F.desc(id_col)).limit(k)
    w = Window.orderBy(F.desc("score"), F.desc(id_col))
    return top.select(F.row_number().over(w).cast("int").alias("rank"), id_col, "score")


def _batch_candidates(s: np.ndarray, ids: np.ndarray, k: int):
    """The k best columns of each row of ``s`` (rows = queries), exact under
    ties: rows with a tie at the k-th score are resolved by id, one by one."""
    m = s.shape[1]
    if m <= k:
        return s, np.broadcast_to(ids, s.shape)
    part = np.argpartition(-s, k - 1, axis=1)[:, :k]
    top_s = np.take_along_axis(s, part, axis=1)
    top_i = ids[part]
    kth = top_s.min(axis=1)
    tied = (s >= kth[:, None]).sum(axis=1) > k
    for r in np.nonzero(tied)[0]:
        cand = np.nonzero(s[r] >= kth[r])[0]
        o = np.lexsort((-ids[cand], -s[r, cand]))[:k]
        top_s[r], top_i[r] = s[r, cand[o]], ids[cand[o]]
    return top_s, top_i


def _packed(vectors: DataFrame, id_col: str, vec_col: str, block_rows: int) -> tuple[DataFrame, int, int]:
    """(block, ids, vectors), about ``block_rows`` vectors that have a direction a block, ids falling; the number of blocks,
    and of bytes of the vectors. Floats stay floats: they take half the room of doubles."""
    kind = vectors.schema[vec_col].dataType.elementType.typeName()
    number = F.col("v") if kind in ("float", "double") else F.transform("v", lambda x: x.cast("double"))
    usable = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).alias("v")).select("i", number.alias("v")).filter(
        F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("v", lambda x: x != 0))
    n, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // block_rows))
    # the place in its partition deals the rows evenly, whatever the ids are
    block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")
    grouped = usable.select("i", "v", block.alias("block")).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("i", "v")), asc=False).alias("r"))
    return grouped.select("block", F.col("r.i").alias("ids"), F.col("r.v").alias("vectors")), blocks, size * (4 if kind == "float" else 8)


def _unit(vectors) -> np.ndarray:
    """A block's vectors (an Arrow list of lists) as rows of length 1. Squares are added in order, as in ``norm``."""
    lengths = set(vectors.value_lengths().to_pylist())
    if len(lengths) > 1:
        raise ValueError(f"vectors of one side have {min(lengths)} and {max(lengths)} dimensions")
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    total = np.zeros(len(v))
    for d in range(v.shape[1]):
        total += v[:, d] * v[:, d]
    return v / np.sqrt(total)[:, None]


class _Best:
    """The k best scores so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.scores, self.k = np.full((n, k), -np.inf), k

    def add(self, s: np.ndarray):
        """(rows, columns) of the scores ``s`` that are among the k first so far, ties at the k-th all of them, but of each row
        the k first of ``s`` at most: score falling, then column."""
        n, m = s.shape
        reach = s >= self.scores.min(axis=1)[:, None]
        count = reach.sum(axis=1)
        many = np.nonzero(count > self.k)[0]
        if len(many):
            reach[many] = False
            _, first = _batch_candidates(s[many], np.arange(m)[::-1], self.k)
            reach[many[:, None], m - 1 - first] = True
        rows, cols = np.divmod(np.flatnonzero(reach), m)
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        new = np.full((n, self.k), -np.inf)
        new[rows, at] = s[rows, cols]
        hit = np.unique(rows)
        self.scores[hit] = np.partition(np.concatenate([self.scores[hit], new[hit]], axis=1), self.k, axis=1)[:, self.k:]
        return rows, cols


def _scored(k: int, names: list[str]):
    """Batches of pairs of blocks, those of a query block together -> batches of (query id, id, score)."""
    def run(batches):
        import pyarrow as pa

        block = None
        for batch in batches:
            for n in range(batch.num_rows):
                at, q_ids, q_vec, c_ids, c_vec = (batch.column(c)[n] for c in ("q_block", "q_ids", "q_vectors", "c_ids", "c_vectors"))
                if at.as_py() != block:
                    block, q = at.as_py(), _unit(q_vec.values)
                    best = _Best(len(q), k)
                c = _unit(c_vec.values)
                if q.shape[1] != c.shape[1]:
                    raise ValueError(f"query vectors have {q.shape[1]} dimensions, corpus vectors {c.shape[1]}")
                s = q @ c.T
                rows, cols = best.add(s)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([q_ids.values.take(pa.array(rows)), c_ids.values.take(pa.array(cols)), pa.array(s[rows, cols])], names)
    return run


def top_k(queries: DataFrame, corpus: DataFrame, k: int = DEFAULT_TOP_K, id_col: str = "vec_id",
          vec_col: str = "embedding", query_id_col: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact batch top-k: (query_id, rank, id, score) for every query."""
    spark = queries.sparkSession
    ensure_on_executors(spark)
    qid = query_id_col or id_col
    cs, c_blocks, c_bytes = _packed(corpus, id_col, vec_col, block_rows)
    qs, q_blocks, q_bytes = (cs, c_blocks, c_bytes) if queries is corpus and qid == id_col else _packed(queries, qid, vec_col, block_rows)
    # a grid of tasks: few queries still meet the parts of the corpus in a task each
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    side = math.isqrt(tasks - 1) + 1
    rows = max(-(-q_bytes // SIDE_BYTES), min(q_blocks, side))
    cols = max(-(-c_bytes // SIDE_BYTES), min(c_blocks, side if rows >= side else -(-tasks // rows)))
    left, right = (df.repartition(n).select(*(F.col(c).alias(f"{name}_{c}") for c in df.columns))
                   for df, n, name in ((qs, rows, "q"), (cs, cols, "c")))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right).select("q_block", "q_ids", "q_vectors", "c_ids", "c_vectors")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, qid), (corpus, id_col))]
    found = pairs.mapInArrow(_scored(k, ["query_id", id_col, "score"]), f"query_id {kinds[0]}, `{id_col}` {kinds[1]}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(id_col))
    ranked = found.withColumn("rank", F.row_number().over(w).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
