import numpy as np
import pytest

from tessera.operators import search as se
from tessera.operators import search_pruned as sp
from tessera.operators.search_pruned import top_k_pruned


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def clusters(rng, n, dims=8, centres=12, width=0.02):
    c = rng.normal(size=(centres, dims))
    c /= np.linalg.norm(c, axis=1)[:, None]
    return c[rng.integers(0, centres, n)] + rng.normal(scale=width, size=(n, dims))


@pytest.mark.parametrize("block_rows,pivots,cell", [(16, 12, 2), (7, 5, 1), (2048, 256, 4)])
def test_equal_to_the_whole_search(spark, block_rows, pivots, cell):
    rng = np.random.default_rng(1)
    corpus = np.concatenate([clusters(rng, 150), rng.normal(size=(30, 8)), np.zeros((2, 8)), clusters(rng, 5)[[0, 0, 0]]])
    queries = np.concatenate([clusters(rng, 40), rng.normal(size=(10, 8))])
    c, q = frame(spark, corpus), frame(spark, queries, 1000)
    got, _ = top_k_pruned(q, c, k=5, block_rows=block_rows, pivots=pivots, cell_blocks=cell)
    assert rows(got) == rows(se.top_k(q, c, k=5))


def test_ties_and_few_vectors(spark):
    c = frame(spark, [[1, 0], [1, 0], [2, 0], [0, 1]])
    got, _ = top_k_pruned(c, c, k=3, block_rows=1, pivots=2, cell_blocks=1)
    assert rows(got) == rows(se.top_k(c, c, k=3))
    got, _ = top_k_pruned(c, c, k=50, block_rows=1, pivots=2, cell_blocks=1)
    assert len(rows(got)) == 16


def test_clustered_vectors_skip_most_pairs(spark):
    rng = np.random.default_rng(2)
    v = clusters(rng, 600, dims=16, centres=20, width=0.005)
    df = frame(spark, v)
    got, saved = top_k_pruned(df, df, k=5, block_rows=32, pivots=64, cell_blocks=4)
    s = saved.first()
    assert s["share"] > 0.5 and 0 < s["skipped"] < s["pairs"]
    assert rows(got) == rows(se.top_k(df, df, k=5))


def test_empty_sides_and_wrong_dimensions(spark):
    c, none = frame(spark, [[1, 0], [0, 1]]), frame(spark, [])
    assert top_k_pruned(none, c)[0].collect() == [] == top_k_pruned(c, none)[0].collect()
    with pytest.raises(Exception, match="dimensions"):
        top_k_pruned(frame(spark, [[1, 0, 0]]), c)[0].collect()


def test_copies_of_a_vector_are_bounded(spark, monkeypatch):
    """Few vectors in many small blocks are copied GRID_SIDE times, not once for every few blocks."""
    sent = []
    cells = sp._cells

    def seen(queries, corpus, *rest):
        sent.append((queries, corpus))
        return cells(queries, corpus, *rest)

    monkeypatch.setattr(sp, "_cells", seen)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sp.top_k_pruned(v, v, k=3, block_rows=2, pivots=64)[0].collect()
    want = se.top_k(v, v, k=3).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((r["query_id"], r["rank"], r["vec_id"]) for r in want)
    for side in sent[1]:
        assert side.groupBy("block").count().agg({"count": "max"}).first()[0] <= sp.GRID_SIDE


def test_a_cell_keeps_k_of_each_query():
    rng = np.random.default_rng(6)
    c = [(np.arange(20 * b, 20 * b + 20)[::-1], np.round(rng.normal(size=(20, 2)))) for b in range(7)]
    q = ([0, 1, 2], np.round(rng.normal(size=(3, 2))))
    score, ids, _, skipped = sp._best(q, c, 4, [1.0] * 7, -2.0)
    assert score.shape == ids.shape == (3, 4) and skipped == 0
    for r in range(3):
        every = sorted(((float(q[1][r] @ v), int(i)) for b_ids, m in c for i, v in zip(b_ids, m, strict=True)), reverse=True)[:4]
        assert [(float(s), int(i)) for s, i in zip(score[r], ids[r], strict=True)] == every
