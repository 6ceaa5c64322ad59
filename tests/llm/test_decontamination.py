import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.decontamination import RADIUS, drop_contaminated, item_table, leaked_pairs, simhash, within_radius

from .helpers import docs_frame

BENCH = "item_id long, text string"


def similarity(a, b, k):
    x, y = (Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    common = sum((x & y).values())
    return common / (sum(x.values()) + sum(y.values()) - common)


def brute(texts, items):
    """(doc, item) -> best similarity over all windows of the item's size, clipped at the ends."""
    out = {}
    for d, t in enumerate(texts):
        ws = (t or "").lower().split()
        for i, item in items:
            iw = (item or "").lower().split()
            if not iw or not ws:
                continue
            k, n = min(5, len(iw)), len(iw)
            spans = {(max(s, 0), min(s + n, len(ws))) for s in range(1 - n, len(ws))}
            best = max((similarity(ws[a:b], iw, k) for a, b in spans if b - a >= k), default=0)
            if best >= 0.8:
                out[d, i] = best
    return out


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(60)]

    def words(n):
        return rng.choices(vocabulary, k=n)

    items = [(i, " ".join(words(rng.randint(12, 50)))) for i in range(25)] + [(90, "tiny item here"), (91, None), (92, " "), (93, "solo")]
    texts = []
    for _ in range(80):
        ws = words(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            leak = rng.choice(items[:26])[1].split()
            kind = rng.randrange(4)
            if kind == 1:
                leak = leak[rng.randint(0, 3):]
            elif kind == 2:
                leak[rng.randrange(len(leak))] = "edited"
            elif kind == 3:
                leak = [w.upper() for w in leak]
            at = rng.randint(0, len(ws))
            ws[at:at] = leak
        texts.append(rng.choice([" ", "\n"]).join(ws))
    return texts + ["", None, "tiny ITEM here", "a solo act", items[0][1], items[0][1][:-3]], items


def test_pairs_against_brute_force(spark):
    texts, items = corpus(random.Random(7))
    bench = spark.createDataFrame(items, BENCH)
    docs = docs_frame(spark, texts, extra="1 as id;2 as mark;3 as item_id;4 as words")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaked_pairs(docs, bench).collect()}
    want = brute(texts, items)
    assert len(want) > 40
    assert got.keys() <= want.keys()
    # windows lie where a shingle is shared, aligned as in the item; all planted items are found
    assert {k for k, s in want.items() if s >= 0.85} <= got.keys() and len(got) >= 0.97 * len(want)
    assert all(abs(got[k] - want[k]) < 0.12 for k in got) and all(abs(got[k] - 1) < 1e-9 for k, s in want.items() if s == 1)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in got}


def test_all_fingerprints_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base:
        for r in range(0, 24):
            for _ in range(6):
                p = b
                for bit in rng.sample(range(64), r):
                    p ^= 1 << bit
                prints.add(p)
    signed = lambda p: p - (p >> 63 << 64)
    items = spark.createDataFrame([(i, signed(b)) for i, b in enumerate(base)], "item long, print long")
    df = spark.createDataFrame([(signed(p),) for p in prints], "print long")
    got = {tuple(r) for r in within_radius(df, items).collect()}
    assert got == {(signed(p), i) for p in prints for i, b in enumerate(base) if (p ^ b).bit_count() <= RADIUS}


def test_edited_windows_beyond_sixteen_bits_are_found(spark):
    import numpy as np

    def print_of(hashes):
        bits = (hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return 2 * bits.sum(axis=0) > len(hashes)

    import xxhash
    rng, items, texts = random.Random(12), [], []
    n, k = 59, 5  # edge words replaced: (n - 4 - k) / (n - 4 + k) = 0.83
    for _ in range(20_000):
        words = [f"{rng.getrandbits(40):x}" for _ in range(n + k)]
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], dtype=np.uint64)
        if (print_of(hashes[:n]) != print_of(np.concatenate([hashes[n:], hashes[k:n]]))).sum() in (17, 18, 19):
            items.append((len(items), " ".join(words[:n])))
            texts.append(" ".join(["before", "it", *words[n:], *words[k:n], "after"]))
            if len(items) == 5:
                break
    assert len(items) == 5
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaked_pairs(docs_frame(spark, texts), spark.createDataFrame(items, BENCH)).collect()}
    assert got.keys() == {(i, i) for i in range(5)} and all(0.8 <= v <= 0.85 for v in got.values())


def test_simhash_counts_words(spark):
    import xxhash

    texts = ["a b c a", "x", "one two three four five six"]
    for r in simhash(F.split("t", " "), spark.createDataFrame([(t,) for t in texts], "t string"), "p").collect():
        hs = [xxhash.xxh64_intdigest(w.encode(), 42) for w in r["t"].split()]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert r["p"] & ((1 << 64) - 1) == want


def test_repeats_nulls_and_empty_tables(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    bench = spark.createDataFrame([(7, item), (3, item.upper()), (None, "other words that never occur at all")], BENCH)
    docs = docs_frame(spark, [f"x {item} y", f"x {item} y", "clean", item], [1, 1, 2, None])
    assert sorted(((r["doc_id"], r["item_id"]) for r in leaked_pairs(docs, bench).collect()), key=repr) == [(1, 3), (None, 3)]
    assert [r["doc_id"] for r in drop_contaminated(docs, bench).collect()] == [2]
    assert leaked_pairs(docs_frame(spark, []), bench).collect() == []
    assert leaked_pairs(docs, bench.limit(0)).collect() == []
    assert drop_contaminated(docs, bench.limit(0)).count() == 4
    assert item_table(bench).count() == 2


def test_a_very_long_text(spark):
    rng = random.Random(21)
    item = " ".join(f"q{i}" for i in range(30))
    filler = rng.choices([f"w{i}" for i in range(500)], k=300_000)
    texts = [" ".join(filler), " ".join([*filler[:200_000], *item.split(), *filler[200_000:]])]
    items = spark.createDataFrame([(7, item)], BENCH)
    got = {(r["doc_id"], r["item_id"]) for r in leaked_pairs(docs_frame(spark, texts), items).collect()}
    assert got == {(1, 7)}
