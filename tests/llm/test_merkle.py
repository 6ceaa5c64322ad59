import hashlib
import re

from tessera.llm.merkle import differing_leaves, fingerprint_documents, fingerprint_edits, neighbours, _keyed

from .helpers import docs_frame


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_print(text):
    sections = [s for s in re.split(r"(?<=\n\n)(?!\n)", text) if s]
    leaves = [[p for p in re.split(r"(?<=\n)|(?<=\. )", s) if p] for s in sections]
    root = sha("".join(sha("".join(map(sha, ls))) for ls in leaves))
    return root + "".join("/" + ",".join(f"{sha(p)[:12]}-{len(p)}" for p in ls) for ls in leaves), {(sha(p)[:12], len(p)) for ls in leaves for p in ls}


def brute_likeness(a, b):
    total = sum(n for _, n in a | b)
    return sum(n for _, n in a & b) / total if total else 1.0


TEXTS = ["One. Two. Three\nfour\n\n\nnew section\nend", "", None, "a", "ab", "abc", "éü😀. x. " * 30, "same line\n" * 50,
         "One. Two. Three\nfour\n\n\nnew section\nend", "\n\n\n", "x. \n\ny", "long " * 30_000]


def test_against_brute_force(spark):
    ids = [3, 7, 1, 20, 11, 12, 13, 14, 15, 16, 17, 2]
    got = {r["doc_id"]: r.asDict() for r in fingerprint_edits(docs_frame(spark, TEXTS, ids, extra="1 as id;2 as mark;'q' as head")).collect()}
    docs = sorted(((i, t or "") for i, t in zip(ids, TEXTS, strict=True)), reverse=True)
    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text)
        edited = text[:n - n // 3] + after[:n // 3]
        (own, a), (changed, b), (_, c) = map(brute_print, (text, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha(edited), own, changed)
        assert abs(r["near_edited"] - brute_likeness(a, b)) < 1e-12 and abs(r["near_next"] - brute_likeness(a, c)) < 1e-12


def test_neighbours_cross_ranges(spark):
    ids = list(range(0, 5000, 7))
    rows = neighbours(_keyed(docs_frame(spark, ["t"] * len(ids), ids))).collect()
    after = {r["id"]: r["next_id"] for r in rows}
    down = ids[::-1]
    assert after == {i: down[(k + 1) % len(down)] for k, i in enumerate(down)}


def test_repeated_rows_null_ids_and_small_tables(spark):
    df = docs_frame(spark, ["ab\ncd", "ab\ncd", "zz", "ab", "q"], [5, 5, 5, None, 4])
    rows = fingerprint_edits(df).collect()
    assert len(rows) == 5 and len({r["fingerprint"] for r in rows if r["n_chars"] == 5}) == 1
    assert [r["doc_id"] for r in rows].count(None) == 1
    (one,) = fingerprint_edits(docs_frame(spark, ["abc\ndef"])).collect()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == sha("abc\nd" + "ab")
    assert fingerprint_edits(docs_frame(spark, [])).collect() == []


def test_different_blank_lines_differ(spark):
    rows = fingerprint_documents(docs_frame(spark, ["a\n\nb", "a\n\n\nb", "a\nb", "a\n\nb"])).collect()
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[3] and len(set(prints.values())) == 3


def test_differing_branches(spark):
    a = docs_frame(spark, ["one\ntwo\n\nthree\nfour", "same\n\ntext", "x"])
    b = docs_frame(spark, ["one\ntwo\n\nthree\nFOUR", "same\n\ntext", "x\n\nnew"])
    got = sorted(tuple(r) for r in differing_leaves(a, b, "doc_id").collect())
    assert got == [(0, 1, 1, 4, 4), (2, 0, 0, 1, 2), (2, 0, 1, None, 1), (2, 1, 0, None, 3)]
