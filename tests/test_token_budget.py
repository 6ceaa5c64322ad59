import random

import numpy as np
import pytest

from tessera.operators import embed as em


class Enc:
    """Vector (words, batch size, longest of the batch)."""

    def encode(self, texts, max_tokens=512):
        lengths = [min(len(t.split()), max_tokens) for t in texts]
        return np.array([[n, len(texts), max(lengths)] for n in lengths], dtype=np.float32)


def texts(spark, n=700):
    rng = random.Random(9)
    sizes = [rng.choice([0, 1, 3, 5, 20, 200, 900]) for _ in range(n)]
    rows = [(i, None if i % 50 == 7 else " ".join(["w"] * k), k) for i, k in enumerate(sizes)]
    return spark.createDataFrame(rows, "i long, chunk string, k int").repartition(3)


@pytest.mark.parametrize("budget,lookahead", [(1024, 4096), (1024, 40), (100, 64)])
def test_vectors_in_row_order_and_under_the_budget(spark, budget, lookahead):
    got = em.embed(texts(spark), Enc, token_budget=budget, lookahead=lookahead).collect()
    assert len(got) == 700
    for r in got:
        if r.chunk is None:
            assert r.embedding is None
            continue
        words, n, longest = r.embedding
        assert words == min(r.k, 512)
        assert n * longest <= budget or n == 1
        assert n <= min(budget, lookahead)


def test_report(spark):
    df = texts(spark)
    plain, packed = (em.padding_report(df, Enc, token_budget=b).first() for b in (None, 2048))
    assert plain.n_texts == packed.n_texts == 686 and plain.tokens == packed.tokens
    assert packed.most_padded <= 2048 and packed.tokens <= packed.padded_tokens < 0.5 * plain.padded_tokens
    seen = em.embed(df, Enc, token_budget=2048).filter("chunk is not null").selectExpr("sum(embedding[2]) as p", "sum(1 / embedding[1]) as n").first()
    assert (seen.p, round(seen.n)) == (packed.padded_tokens, packed.n_batches)


def test_batches():
    assert [b.tolist() for b in em.budget_batches(np.array([5, 1, 9, 1, 0]), 6)] == [[4, 1, 3], [0], [2]]
    assert em.budget_batches(np.array([], dtype=np.int64), 6) == []


def test_own_token_count(spark):
    class Long(Enc):
        def count_tokens(self, texts):
            return [100] * len(texts)

    got = em.embed(texts(spark).filter("chunk is not null"), Long, token_budget=300).collect()
    assert max(r.embedding[1] for r in got) == 3
    empty = em.padding_report(texts(spark).limit(0), Long, token_budget=300).first()
    assert tuple(empty) == (0, 0, 0, 0, 0)
