import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.functions.text import SENTENCE_TERMINATORS
from tessera.operators import chunk as ch


def _run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {i: [] for i in range(len(texts))}
    for r in sorted(ch.chunk_text(df, **kw).collect(), key=lambda r: (r.doc_id, r.chunk_index)):
        out[r.doc_id].append(r)
    return out


def check_spans(text, spans, size, overlap):
    """What each span must be, said of the whole text and not by walking it."""
    ends = {i + 1 for i, c in enumerate(text) if c in SENTENCE_TERMINATORS}
    assert bool(spans) == bool(text)
    for k, (start, end) in enumerate(spans):
        assert start == (0 if k == 0 else max(spans[k - 1][0] + 1, spans[k - 1][1] - overlap))
        near = [e for e in ends if max(start, start + size - 100) < e <= min(start + size + 50, len(text))]
        if start + size < len(text) and near and max(near) > start + size // 2:
            assert end == max(near)
        else:
            assert end == start + size
    if spans:
        assert max(spans[-1][0] + 1, spans[-1][1] - overlap) >= len(text)


def test_fixture_windows(spark):
    out = _run(spark, ["a" * 1700, "a" * 1200])
    assert [(r.chunk_start, r.chunk_end) for r in out[0]] == [(0, 1000), (800, 1700), (1600, 1700)]
    assert [(r.chunk_start, r.chunk_end) for r in out[1]] == [(0, 1000), (800, 1200)]
    assert [r.chunk_index for r in out[0]] == [0, 1, 2]


@pytest.mark.parametrize("at,end", [(1030, 1031), (1049, 1050), (1050, 1000), (900, 901), (899, 1000)])
def test_terminators_around_the_limit(spark, at, end):
    t = "a" * at + "." + "b" * (2000 - at)
    first = _run(spark, [t])[0][0]
    assert (first.chunk_start, first.chunk_end, first.chunk) == (0, end, t[:end])


def test_boundary_too_early_ignored(spark):
    t = "a" * 30 + "." + "b" * 300
    assert _run(spark, [t], size=100, overlap=20)[0][0].chunk_end == 100  # not past the window's middle


def test_overlap_ge_size_steps_by_one(spark):
    t = "abcdefghij" * 12
    got = _run(spark, [t], size=50, overlap=60)[0]
    assert [r.chunk for r in got] == [t[i:i + 50] for i in range(120)]


def test_chunks_are_stripped_and_blank_ones_dropped(spark):
    t = "a" * 10 + " " * 0 + " b" + "c" * 20
    assert [r.chunk for r in _run(spark, [t], size=11, overlap=0)[0]] == ["a" * 10, "b" + "c" * 10, "c" * 10]
    out = _run(spark, ["", "   \n ", None, "*** @@@"])
    assert all(len(v) == 0 for v in out.values())


PIECES = st.sampled_from(list("abc ءبت.!?؟؛,") + ["xyz. ", "word"])


@settings(max_examples=300, deadline=None)
@given(text=st.lists(PIECES, max_size=600).map("".join), size=st.integers(1, 300), overlap=st.integers(0, 320))
def test_spans_have_their_definition(text, size, overlap):
    check_spans(text, ch.chunk_spans(text, size, overlap), size, overlap)


def test_documents_are_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    from tessera.functions.text import chunk_clean

    texts = {r[0]: r[1] for r in docs.select("doc_id", chunk_clean("text")).collect()}
    by_doc = {}
    for r in ch.chunk_text(docs).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.chunk_index)
        spans = ch.chunk_spans(texts[d], 1000, 200)
        check_spans(texts[d], spans, 1000, 200)
        assert [(r.chunk_start, r.chunk_end) for r in rs] == [(a, min(b, len(texts[d]))) for a, b in spans]
        assert all(r.chunk == texts[d][r.chunk_start:r.chunk_end].strip(" ") for r in rs)
        assert rs[-1].chunk_end == len(texts[d])


def test_partition_count_does_not_change_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = sorted(tuple(r) for r in ch.chunk_text(docs).collect())
    b = sorted(tuple(r) for r in ch.chunk_text(docs.repartition(7)).collect())
    assert a == b


def test_sentence_chunks(spark):
    texts = [" ".join(f"Sentence {i}." for i in range(11)), "One! Two؟ Three؛؛ four", "", "...", "a.b.c.d.e.f.g"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in ch.chunk_by_sentences(df, k=5).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert got == {0: ["Sentence 0 Sentence 1 Sentence 2 Sentence 3 Sentence 4", "Sentence 5 Sentence 6 Sentence 7 Sentence 8 Sentence 9",
                       "Sentence 10"], 1: ["One Two Three four"], 4: ["a b c d e", "f g"]}
