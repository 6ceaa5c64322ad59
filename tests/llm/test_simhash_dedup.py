import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.components import connected_components
from tessera.llm.queries import LLM_QUERIES
from tessera.llm.simhash_dedup import keep_one, near_duplicates, simhash, spanning_forest, trie_links, walk_pairs

from .helpers import docs_frame


def brute_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """component of each (id, print): the smallest id reachable."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc, _) in enumerate(prints):
        groups.setdefault(root(i), []).append(doc)
    low = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return [low[root(i)] for i in range(len(prints))]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAbÉé \t\n.", max_size=60))
def test_simhash_by_hand(text):
    assert simhash(text.encode()) == brute_simhash(text)


def test_simhash_long_and_null():
    assert simhash(None) == 0
    text = " ".join(random.Random(3).choices("abcdefgh", k=70_000))
    assert simhash(text.encode()) == brute_simhash(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60, unique=True), st.integers(0, 3))
def test_walk_finds_all_links(low, radius):
    values = np.array(sorted(x * 0x0101_0000_0000_0001 % (1 << 64) for x in low), dtype=np.uint64)
    if not len(values):
        return
    a, b = walk_pairs([0], [values], [values], radius, direct=2)
    want = {(int(x), int(y)) for x in values for y in values if x < y and (int(x) ^ int(y)).bit_count() <= radius}
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)} == want
    assert len(a) == len(want)


def test_spanning_forest_keeps_components():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 300, 200).astype(np.uint64), rng.integers(0, 300, 200).astype(np.uint64)
    x, y = spanning_forest(a, b)
    full, slim = {}, {}
    for g, (u, v) in ((full, (a, b)), (slim, (x, y))):
        nodes = sorted({*a.tolist(), *b.tolist()})
        g.update({n: n for n in nodes})
        for _ in nodes:
            for p, q in zip(u.tolist(), v.tolist(), strict=True):
                g[p] = g[q] = min(g[p], g[q])
    assert full == slim and len(x) < len(a)


def test_trie_links_with_deep_clusters(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)} | {rng.getrandbits(64) for _ in range(600)}
    prints = sorted(prints)[:2000]
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(trie_links(df, 2, leaf=32)).collect()}
    got = {}
    for p in prints:
        s = p - (p >> 63 << 64)
        got.setdefault(roots.get(s, s), []).append(p)
    want = brute_components([(p, p) for p in prints])
    groups = {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, []).append(p)
    assert sorted(map(sorted, got.values())) == sorted(groups.values())


def test_long_chain_of_links(spark):
    order = list(range(300))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(299)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 300)}, 901: 900}
    assert connected_components(links.limit(0)).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    base = [" ".join(rng.choices(["the", "a", "of", "tree", "Haus", "été", "x"], k=rng.randint(1, 60))) for _ in range(40)]
    texts = base + [t.upper() for t in base[:10]] + [t + " end" for t in base[:20]] + ["", None, " \n", "one", "one two"] + base[:3]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    ids[-1] = ids[-2]
    ids[-3] = None
    df = docs_frame(spark, texts, ids, extra="1 as fp;'x' as component_id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in LLM_QUERIES["op6_simhash_dedup"](spark, str(tmp_path)).collect()), key=repr)
    prints = [(i, brute_simhash(t)) for i, t in zip(ids, texts, strict=True)]
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints), strict=True)), key=repr)
    assert got == want
    kept = [r["doc_id"] for r in keep_one(df).collect()]
    named = [(i, p) for i, p in prints if i is not None]
    assert sorted(kept, key=str) == sorted({c for c in brute_components(named)} | {None}, key=str)
    assert keep_one(df).columns == df.columns


def test_one_row_of_each_component(spark):
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abcd")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c.upper()), (7, c), *[(None, d)] * 50]
    df = docs_frame(spark, [t for _, t in rows], [i for i, _ in rows], extra="1 as id;2 as mark;3 as root;4 as k0").repartition(4)
    got = keep_one(df)
    assert got.columns == df.columns
    want = [(3, a), (5, b), (7, c.upper()), (None, d)]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert near_duplicates(docs_frame(spark, [])).collect() == []
