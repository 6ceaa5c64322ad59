import hashlib
import random

import pytest

from tessera.llm.queries import LLM_QUERIES
from tessera.llm.substring_dedup import drop_repeats, repeated_cells

from .helpers import docs_frame


def brute(docs, window):
    """{row: kept words} by the definition."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, ws in split:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k:k + window])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, ws in split:
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            first = least.get(tuple(ws[k:k + window]))
            if first is not None and (i is None or first < i):
                gone[k:k + window] = [True] * window
        out.append((i, len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n, window):
    words = [f"w{i}" for i in range(40)] + ["É", "ß,"]
    passages = [rng.choices(words, k=window + rng.randint(-2, 30)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choices(words, k=rng.randint(0, 40)) for _ in range(3)]
        for at in range(rng.randint(0, 2)):
            parts.insert(at, rng.choice(passages))
        seps = ["\n", " ", "  ", "\t", "\r\n", "\x0b"]
        texts.append("".join(w + rng.choice(seps) for p in parts for w in p))
    texts += [texts[0], texts[0], " ".join(["same"] * 130), " ".join(["same"] * 90), None, "", "  ", texts[5] + " x"]
    return texts


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    texts = corpus(rng, 60, 50)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = ids[4]  # two rows of one id
    ids[-2] = ids[0] = None
    docs_frame(spark, texts, ids).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in LLM_QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(list(zip(ids, texts, strict=True)), 50)


@pytest.mark.parametrize("width", [64, 1 << 12])
def test_a_narrow_sketch_changes_nothing(spark, width):
    rng = random.Random(2)
    texts = corpus(rng, 30, 8)
    df = docs_frame(spark, texts, extra="1 as n_words;array(1) as hits").repartition(3)
    out = drop_repeats(df, window=8, width=width)
    assert out.columns == [*df.columns, "_n_words", "n_removed"]
    got = sorted(((r["doc_id"], r["_n_words"], r["n_removed"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest())
                  for r in out.collect()), key=repr)
    assert got == brute(list(enumerate(texts)), 8)


def test_sketch_finds_cells_of_repeats_only(spark):
    once = " ".join(f"a{i}" for i in range(200))
    assert repeated_cells(docs_frame(spark, [once])).collect() == []
    assert repeated_cells(docs_frame(spark, [once, "x " + once])).count() > 0


def test_kept_text_keeps_its_white_space(spark):
    run = " ".join(f"p{i}" for i in range(8))
    texts = [f"lead\n{run}\ntail", f"one\n\n{run}\ttwo \n", f"{run}", f" {run} end", "short\n text"]
    out = {r["doc_id"]: r["text"] for r in drop_repeats(docs_frame(spark, texts), window=8).collect()}
    assert out == {0: texts[0], 1: "one\ttwo \n", 2: "", 3: " end", 4: "short\n text"}


def test_long_words_and_texts(spark):
    big = "y" * (1 << 21)
    texts = [f"{big} " + " ".join(f"q{i}" for i in range(60_000)), f"{big} " + " ".join(f"q{i}" for i in range(60_000)) + " more"]
    got = sorted(tuple(r) for r in drop_repeats(docs_frame(spark, texts)).select("doc_id", "n_words", "n_removed", "text").collect())
    assert got == [(0, 60_001, 0, texts[0]), (1, 60_002, 60_001, " more")]


def test_empty(spark):
    assert drop_repeats(docs_frame(spark, [])).collect() == []
