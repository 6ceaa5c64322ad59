import random
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import spelling as sp
from tessera.llm.queries import LLM_QUERIES

from .helpers import docs_frame


def is_letter(c):
    return "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ"


def brute_words(docs):
    """Word counts by the definition."""
    out = Counter()
    for doc, text in docs:
        run = ""
        for c in (text or "") + " ":
            if is_letter(c):
                run += c.lower() if "A" <= c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % 31 == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1:]
                if len(run) >= 7:
                    out[run] += 1
            run = ""
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute_variants(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def slip(rng, w, letters):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]])


def corpus(rng):
    letters = "abcdeÀÉéßÿ÷×"
    stems = ["".join(rng.choices(letters, k=rng.randint(6, 13))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "Zürichsee"]
    texts = []
    for _ in range(60):
        ws = []
        for w in rng.choices(stems, weights=[100 if i % 5 == 0 else 8 if i % 5 < 3 else 2 for i in range(len(stems))], k=rng.randint(0, 120)):
            r = rng.random()
            w = w if r < 0.7 else slip(rng, w, letters) if r < 0.95 else slip(rng, slip(rng, w, letters), letters)
            ws.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        texts.append("".join(w + rng.choice([" ", ", ", "1", "\n", "_", "ж"]) for w in ws))
    # two steps of forms
    texts += ["qrstuvwx " * 260, "qrstuvwy " * 25 + "qrstuvzy qrstuvzy"]
    return [*texts, texts[0], None, "", "  12 ", "Ā" * 9, "short words only"]


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = corpus(rng)
    ids = [rng.randrange(10**6) for _ in texts]
    ids[2] = ids[1]
    ids[5] = None
    docs_frame(spark, texts, ids, extra="1 as word;2 as n").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    df = LLM_QUERIES["op11_spelling_variants"](spark, str(tmp_path))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(brute_words(list(zip(ids, texts, strict=True))))
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] != r[1] and r[1] for r in want)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == want


def test_a_dictionary_of_any_threshold_finds_the_same(spark):
    rng = random.Random(4)
    words = {}
    for _ in range(400):
        w = "".join(rng.choices("abÉ", k=rng.randint(7, 12)))
        words[w] = 2 ** rng.randint(1, 12)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute_variants(words)
    for frequent in (0, 5, 60, 10**9):
        assert sorted((tuple(r) for r in sp.group_variants(df, frequent).collect()), key=repr) == want


def unaffected(a, b, counts, frequent):
    pad = lambda w: sp.HEAD * sp.PAD + w + sp.TAIL * sp.PAD
    a, b = pad(a), pad(b)
    grams = sp.decompose(a, counts, frequent)
    ours, theirs = Counter(a[x:y] for x, y in grams), Counter(b[x:y] for x, y in sp.decompose(b, counts, frequent))
    return len(grams) - sp.most_affected(a, grams, counts, frequent), sum((ours & theirs).values())


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=7, max_size=12), st.data())
def test_an_edit_changes_no_more_grams_than_the_bound(a, data):
    k = data.draw(st.integers(0, len(a)))
    c = data.draw(st.sampled_from("abcd"))
    b = data.draw(st.sampled_from([a[:k] + a[k + 1:], a[:k] + c + a[k:], a[:k] + c + a[k + 1:]]))
    others = data.draw(st.lists(st.text("abc", min_size=7, max_size=9), max_size=12))
    counts = Counter()
    for w in {a, b, *others}:
        p = sp.HEAD * sp.PAD + w + sp.TAIL * sp.PAD
        counts.update(p[i:i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    for frequent in (0, 1, 2, 4, 8):
        least, shared = unaffected(a, b, counts, frequent)
        assert 1 <= least <= shared
        least, shared = unaffected(b, a, counts, frequent)
        assert 1 <= least <= shared


def test_very_long_words(spark):
    long = "".join(random.Random(5).choices("abcdefgh", k=200_000))
    words = {long: 30, long[:1000] + long[1001:]: 3, long[:70] + "z" + long[70:]: 2}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted((r["n"], r["n_near"], r["form_n"], len(r["root"])) for r in sp.group_variants(df).collect())
    assert got == [(2, 1, 30, 200_000), (3, 1, 30, 200_000), (30, 2, None, 200_000)]


def test_empty(spark):
    assert sp.spelling_variants(docs_frame(spark, [])).collect() == []
    assert sp.spelling_variants(docs_frame(spark, [None, "", "few short"])).collect() == []
