import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators.chunk import chunk_spans, chunk_text
from tessera.operators.chunk_blocks import Block, chunk_text_blocks


def spans_by_blocks(text, size, overlap, block):
    """The three steps on one text: windows, and emitted windows before each block."""
    reach, ahead = max(1, size + 50 - overlap), size + 50
    entry, before, out = 0, 0, []
    for first in range(0, len(text), block):
        length = min(block, len(text) - first)
        b = Block(text[first:first + block + ahead], length, len(text) - first, size, overlap)
        assert before == sum(text[x:y].strip(" ") != "" for x, y in out)
        out += [(first + x, first + y) for x, y in b.walk(entry)]
        to, chunks = b.table(reach)
        assert len(to) == reach
        before += int(chunks[entry])
        entry = int(to[entry])
    return out


@settings(max_examples=300, deadline=None)
@given(st.text("ab .!؟", max_size=600), st.integers(1, 120), st.integers(0, 130), st.integers(1, 200))
def test_blocks_walk_as_the_whole_text(text, size, overlap, block):
    assert spans_by_blocks(text, size, overlap, block) == chunk_spans(text, size, overlap)


def test_default_sizes_on_a_long_text():
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh    .", weights=[1] * 12 + [0.1], k=100_000))
    for block in (500, 4096, 99_999):
        assert spans_by_blocks(text, 1000, 200, block) == chunk_spans(text, 1000, 200)


@pytest.mark.parametrize("size,overlap,block", [(1000, 200, 5000), (60, 80, 100), (3, 0, 101)])
def test_rows_equal_the_chunker(spark, size, overlap, block):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab c.؟$\n", k=rng.choice([0, 1, 50, 3000]))) for _ in range(12)] + [None, "   ", "é. " * 3000]
    df = spark.createDataFrame([(i % 5, t, [i]) for i, t in enumerate(texts)], "id long, text string, tags array<int>").repartition(3)
    got = sorted(map(repr, chunk_text_blocks(df, size=size, overlap=overlap, block_chars=block).collect()))
    assert got == sorted(map(repr, chunk_text(df, size=size, overlap=overlap).collect()))


def test_one_text_takes_as_many_tasks_as_blocks(spark):
    text = "Some words of a sentence that goes on. " * 60_000
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = chunk_text_blocks(df, block_chars=100_000)
    assert got.rdd.getNumPartitions() == -(-(len(text) - 1) // 100_000)
    want = chunk_spans(text.strip(), 1000, 200)
    rows = got.orderBy("chunk_index").collect()
    assert [(r["chunk_start"], r["chunk_end"]) for r in rows] == [(a, min(b, len(text) - 1)) for a, b in want]
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))


def test_empty_and_bad_sizes(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert chunk_text_blocks(df).collect() == [] and chunk_text_blocks(df).columns == chunk_text(df).columns
    with pytest.raises(ValueError):
        chunk_text_blocks(df, size=0)


def test_many_small_blocks_are_not_a_task_each(spark):
    text = "Some words of a sentence that goes on. " * 500
    df = spark.createDataFrame([(i, text) for i in range(9)], "id long, text string").repartition(3)
    got = chunk_text_blocks(df, size=100, overlap=20, block_chars=500)
    assert got.rdd.getNumPartitions() <= 128  # 351 blocks
    assert sorted(map(repr, got.collect())) == sorted(map(repr, chunk_text(df, size=100, overlap=20).collect()))
