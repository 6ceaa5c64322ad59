import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tessera.llm import importance as im
from tessera.llm.queries import LLM_QUERIES

from .helpers import docs_frame

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target):
    s, t = Counter(), Counter()
    found = [(d, *brute_features(x)) for d, x in docs]
    for _, _, f in found:
        s.update(f)
    for x in target:
        t.update(brute_features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for d, n, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    order = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(order[:5 * len(order) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def corpus(rng, n):
    vocab = [f"W{i}" for i in range(300)] + ["É", "naïve", "İ", "\xa0x", "x²", "日本", "Zürich", "i̇"]
    seps = [" ", "  ", ", ", "\n", "\x00", "{", "_", "@@", "\x7f"]
    texts = ["".join(w + rng.choice(seps) for w in rng.choices(vocab, k=rng.choice([0, 1, 2, 3, 19, 20, 21, 80]))) for _ in range(n)]
    return [*texts, texts[3], None, "", " .. ", "a b"]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts, target = corpus(rng, 300), corpus(rng, 20)
    ids = rng.sample(range(10**9), len(texts))
    ids[4] = None
    ids[7] = ids[9]
    docs_frame(spark, texts, ids, extra="1 as rank;2 as buckets").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(target)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = LLM_QUERIES["op12_importance_resampling"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = sorted((tuple(r) for r in df.collect()), key=repr), brute(list(zip(ids, texts, strict=True)), target)
    assert got == want
    assert sum(r[4] is not None for r in got) >= 5


@pytest.mark.parametrize("block", [1, 7, 64])
def test_blocks_change_nothing(block):
    rng = random.Random(7)
    for text in corpus(rng, 30):
        lowered = (text or "").translate(str.maketrans(im.UPPER, im.LOWER))
        n, found = im.feature_buckets(lowered, block=block)
        assert (n, sorted(found.tolist())) == (brute_features(text)[0], sorted(brute_features(text)[1]))


def test_very_long_text():
    rng = random.Random(8)
    text = " ".join(rng.choices(["ab", "cd", "ö" * 3], k=700_000)) + " " + "y" * (1 << 21)
    n, found = im.feature_buckets(text)
    assert n == 700_001 and sorted(found.tolist()) == sorted(brute_features(text)[1])


def test_ties_and_repeated_rows(spark):
    text = " ".join(["same"] * 30)
    rows = im.resample(docs_frame(spark, [text] * 40, [5] * 40), docs_frame(spark, [text])).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2] and len({r["score"] for r in rows}) == 1


def test_empty_tables(spark):
    none = docs_frame(spark, [])
    assert im.resample(none, none).collect() == []
    assert im.resample(none, docs_frame(spark, ["a b c"])).collect() == []
    one = im.resample(docs_frame(spark, ["a b c", None]), none).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in one) == [(0, 6, None), (1, 0, None)]
