"""Property tests of the native text functions: what their results must hold."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.decode import decode_text

ALPHABET = st.sampled_from(list(tx.WS_CHARS) + list("aZ9_ßé.,!?؟؛:،-()[]{}*@=\"'") +
                           ["ما", "مُ", "٣", "²", "¼", "​", "﻿", "\n\n"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=60).map("".join), min_size=1, max_size=20)
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _apply(spark, fn, values, schema="t string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


@SETTINGS
@given(texts=TEXTS)
def test_whitespace_functions(spark, texts):
    assert _apply(spark, tx.ws_trim, texts) == [t.strip() for t in texts]
    assert _apply(spark, tx.ws_collapse, texts) == [" ".join(t.split()) for t in texts]


@SETTINGS
@given(texts=TEXTS)
def test_cleaning_and_sentences(spark, texts):
    cleaned = _apply(spark, tx.chunk_clean, texts)
    for t, c in zip(texts, cleaned, strict=True):
        # letters, digits, signs that stay and white space as one blank; nothing else, in the same order
        kept = [x for x in t if x.isalnum() or x == "_" or x in tx.KEEP_PUNCTUATION]
        assert [x for x in c if x != " "] == kept and c == c.strip(" ") and set(c) <= set(kept) | {" "}
    for c, sentences in zip(cleaned, _apply(spark, lambda c: tx.split_sentences(tx.chunk_clean(c)), texts), strict=True):
        assert all(s and s == s.strip() and not set(s) & set(tx.SENTENCE_TERMINATORS) for s in sentences)
        assert "".join(sentences).replace(" ", "") == "".join(x for x in c if x not in tx.SENTENCE_TERMINATORS).replace(" ", "")


@SETTINGS
@given(texts=TEXTS)
def test_clean_txt(spark, texts):
    head, tail = "=" * 50 + "\nTEXT DOCUMENT\n" + "=" * 50 + "\n\n", "\n\n" + "=" * 50
    for t, c in zip(texts, _apply(spark, tx.clean_txt, texts), strict=True):
        assert c.startswith(head) and c.endswith(tail)
        # every line keeps its place and is its words with one blank between
        assert c[len(head):-len(tail)].split("\n") == [" ".join(x.split()) for x in t.split("\n")]


@SETTINGS
@given(blobs=st.lists(st.binary(max_size=40), min_size=1, max_size=20))
def test_decode_cascade(spark, blobs):
    for b, t in zip(blobs, _apply(spark, decode_text, blobs, "t binary"), strict=True):
        assert "\r" not in t
        try:
            utf8 = b.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if utf8.strip():
            assert t == utf8.replace("\r\n", "\n").replace("\r", "\n")
