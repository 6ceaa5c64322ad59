import hashlib
import random

import pytest

from tessera.llm import suffix_levels as sl
from tessera.llm.queries import LLM_QUERIES

from .helpers import docs_frame


def brute(docs, window=50):
    least = {}
    rows = [(i, (t or "").encode()) for i, t in docs]
    for i, b in rows:
        for k in range(len(b) - window + 1):
            if i is not None:
                w = b[k:k + window]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - window + 1):
            first = least.get(b[k:k + window])
            if first is not None and (i is None or first < i):
                gone[k:k + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n):
    words = [f"w{i}" for i in range(50)] + ["É", "日本", "ß,"]
    passage = [" ".join(rng.choices(words, k=rng.randint(8, 40))) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(2)]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passage)
            a = rng.randint(0, len(p) // 3)
            parts.insert(rng.randint(0, 2), p[a:a + rng.randint(20, 200)])
        texts.append("".join(parts))
    period = "ab" * 90
    return [*texts, texts[0], texts[0], texts[1] + "x", "a" * 300, "b" + "a" * 200, period, period + "c", period[:60], None, "", " ", "\x00" * 60, "z" + "\x00" * 70]


def digest(df):
    from pyspark.sql import functions as F

    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.coalesce("kept", F.lit(b"")), 256))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    texts = corpus(rng, 60)
    ids = rng.sample(range(10**6), len(texts))
    ids[5] = ids[6]
    ids[-4] = ids[0] = None
    docs_frame(spark, texts, ids).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    df = LLM_QUERIES["op13_suffix_dedup"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert rows(df) == brute(list(zip(ids, texts, strict=True)))


@pytest.mark.parametrize("sizes", [{"hot": 2}, {"cells": 64, "batches": 1}, {"batches": 7, "bucket_bytes": 1}])
def test_sizes_change_nothing(spark, sizes):
    texts = corpus(random.Random(14), 25)
    df = docs_frame(spark, texts, extra="1 as mark;2 as ranges;3 as N_spans").repartition(3)
    out = sl.cut_repeats(df, **sizes)
    assert out.columns == [*df.columns, "kept", "n_bytes", "n_removed", "_n_spans"]
    assert rows(digest(out.drop("N_spans").withColumnRenamed("_n_spans", "n_spans"))) == brute(list(enumerate(texts)))


def test_many_batches(spark):
    texts = corpus(random.Random(15), 20)
    assert rows(digest(sl.cut_repeats(docs_frame(spark, texts), batches=8))) == brute(list(enumerate(texts)))


def test_levels_merge_geometrically(monkeypatch):
    merges, met = [], []
    real, scan = sl.merge_levels, sl.merge_scan
    monkeypatch.setattr(sl, "merge_levels", lambda a, b: (merges.append((len(a), len(b))), real(a, b))[1])
    monkeypatch.setattr(sl, "merge_scan", lambda batch, levels, gram: (met.append([len(x) for x in levels]), scan(batch, levels, gram))[1])
    bodies = {k: [sl.pack([[k], [0], [0], [0]], [b"%03d" % k + b"-" * 60])] for k in range(8)}
    assert [len(hits) for hits in sl.index_family(bodies, 50, 16)] == [0] * 8
    assert merges == [(1, 1), (1, 1), (2, 2), (1, 1)]
    assert met == [[], [1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]


def test_merge_scan_walks_all_levels():
    def array(*xs):
        return [(x, x, 0) for x in xs]

    got = list(sl.merge_scan(array(b"aa1", b"aa2", b"cc1", b"dd1"), [array(b"aa0", b"bb0", b"dd0"), array(b"aa9", b"zz0")], 2))
    assert [([m[0] for m in x], [o[0] for o in y]) for x, y in got] == [
        ([b"aa1", b"aa2"], [b"aa0", b"aa9"]), ([b"cc1"], []), ([b"dd1"], [b"dd0"])]


def test_very_long_text(spark):
    rng = random.Random(16)
    long = "".join(rng.choices("abcdefghij klmnop", k=(1 << 20) * 2 + 777))
    texts = [long, "x" + long[(1 << 20) - 300:(1 << 20) + 300] + "y", long + "tail"]
    got = rows(sl.cut_repeats(docs_frame(spark, texts)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept"))
    assert got == [(0, len(long), 0, 0, long.encode()), (1, 602, 600, 1, b"xy"), (2, len(long) + 4, len(long), 1, b"tail")]


def test_empty(spark):
    assert sl.cut_repeats(docs_frame(spark, [])).collect() == []
