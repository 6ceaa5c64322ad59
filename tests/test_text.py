import sys

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx

ODD_WS = "a\tb\x0bc\x1cd\x85e\xa0f g　h  i"
SAMPLES = [
    "ما هي العاصمة؟ القاهرة؛ نعم، صحيح.",
    "مُحَمَّد",
    "٣ ² ¼ ß É _",
    'a * b = "c" @ d',
    ODD_WS,
    "  \n\t lead and trail 　 ",
    "Hello, world! (test) [x] {y}: done?",
    "",
    "﻿BOM text",
]


def _one(spark, col_fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col_fn(F.col("t"))).collect()]


def test_ws_chars_match_python_isspace():
    assert all(c.isspace() for c in tx.WS_CHARS)
    assert sum(1 for c in range(sys.maxunicode + 1) if chr(c).isspace()) == len(tx.WS_CHARS)


def test_ws_trim_and_collapse_match_python(spark):
    assert _one(spark, tx.ws_trim, SAMPLES) == [s.strip() for s in SAMPLES]
    assert _one(spark, tx.ws_collapse, SAMPLES) == [" ".join(s.split()) for s in SAMPLES]


def test_every_whitespace_char_collapses(spark):
    vals = [f"a{c}{c}b{c}" for c in tx.WS_CHARS]
    assert _one(spark, tx.ws_collapse, vals) == ["a b"] * len(vals)


def test_chunk_clean_of_samples(spark):
    assert _one(spark, tx.chunk_clean, SAMPLES) == [
        "ما هي العاصمة؟ القاهرة؛ نعم، صحيح.", "محمد", "٣ ² ¼ ß É _", "a  b  c  d", "a b c d e f g h i", "lead and trail",
        "Hello, world! (test) [x] {y}: done?", "", "BOM text"]


def test_chunk_clean_fixtures(spark):
    out = _one(spark, tx.chunk_clean, ["مُحَمَّد", "٣ ² ¼ ß É _", 'a * b = "c" @ d'])
    assert out[0] == "محمد"          # diacritics deleted
    assert out[1] == "٣ ² ¼ ß É _"   # digits, letters, underscore kept
    assert out[2] == "a  b  c  d"    # deleting after collapsing keeps double spaces


def test_sentence_boundary(spark):
    df = spark.createDataFrame([("abc. def! gh",), ("no terminator",), ("نعم؟ لا",)], "t string")
    got = [r[0] for r in df.select(tx.sentence_boundary("t", F.lit(10))).collect()]
    assert got == [10 + 9, None, 10 + 4]


def test_split_sentences_arabic(spark):
    s = "ما هي العاصمة؟ القاهرة؛ نعم، صحيح. ...  ! end"
    got = _one(spark, tx.split_sentences, [s])[0]
    assert got == ["ما هي العاصمة", "القاهرة", "نعم، صحيح", "end"]


BANNER, FOOT = "=" * 50 + "\nTEXT DOCUMENT\n" + "=" * 50 + "\n\n", "\n\n" + "=" * 50


def test_clean_txt_of_samples(spark):
    vals = ["line one\n\n  line   two  \n\t\nlast", "\n\nlead", "", "a\x0bb\nc d"]
    assert _one(spark, tx.clean_txt, vals) == [
        BANNER + t + FOOT for t in ("line one\n\nline two\n\nlast", "\n\nlead", "", "a b\nc d")]


def test_paragraphs(spark):
    got = _one(spark, tx.paragraphs, [BANNER + "p1 line\n\np2\n\n\n\np3" + FOOT])[0]
    assert got == [BANNER.strip(), "p1 line", "p2", "p3", FOOT.strip()]


def test_wrap_dataset_chunk(spark):
    got = _one(spark, tx.wrap_dataset_chunk, ["123456789", "1234567890", "  a   b  c d e f  "])
    assert got[0] == ""
    assert got[1] == tx.DATASET_CHUNK_HEADER + "1234567890" + tx.DATASET_CHUNK_FOOTER
    assert got[2] == tx.DATASET_CHUNK_HEADER + "a b c d e f" + tx.DATASET_CHUNK_FOOTER


@pytest.mark.parametrize("value,expected", [("x" * 100, "x" * 100), ("x" * 101, "x" * 100 + "..."), (None, None)])
def test_preview(spark, value, expected):
    assert _one(spark, tx.preview, [value])[0] == expected


def test_ids_and_names(spark):
    df = spark.createDataFrame([(7, 2)], "r long, q int")
    r = df.select(tx.qa_id("r", "q"), F.format_string(tx.CHUNK_QA_FILE_FORMAT, "r", "q"),
                  F.format_string(tx.DATASET_CHUNK_FILE_FORMAT, "r")).first()
    assert tuple(r) == ("dataset_7_question_2", "chunk_0007_qa_02.json", "dataset_chunk_000007.txt")
