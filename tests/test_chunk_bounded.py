"""Chunks leave Python in batches of bounded size, whatever a text gives."""
import pyarrow as pa

from tessera.operators import chunk as ch


def _walked(texts, size, overlap, keys=None):
    kept = pa.StructArray.from_arrays([pa.array(keys if keys is not None else range(len(texts)))], ["k"])
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), kept], ["chunk", "kept"])
    return list(ch._walker(size, overlap)(iter([batch])))


def test_one_character_steps_leave_in_bounded_batches():
    texts = ["word and word. " * 4000, None, "", "   ", "a b " * 9000]
    out = _walked(texts, 50, 60)
    assert len(out) > 3
    assert max(b.nbytes for b in out) < 2 * ch.OUT_BYTES
    rows = pa.Table.from_batches(out).to_pylist()
    want = []
    for k, t in enumerate(texts):
        cut = [(a, min(b, len(t)), t[a:b].strip(" ")) for a, b in ch.chunk_spans(t or "", 50, 60)]
        want += [(k, i, *c) for i, c in enumerate(c for c in cut if c[2])]
    assert [(r["kept"]["k"], r["chunk_index"], r["chunk_start"], r["chunk_end"], r["chunk"]) for r in rows] == want


def test_wide_kept_columns_count():
    out = _walked(["x" * 3000], 50, 60, ["y" * 100_000])
    assert max(b.nbytes for b in out) < 2 * ch.OUT_BYTES and sum(b.num_rows for b in out) == 3000


def test_kept_columns_of_any_kind(spark):
    df = spark.createDataFrame([(1, ["p"], {"a": 1}, "one two three. four five six. " * 9), (None, None, None, "seven"), (3, [], {}, None)],
                               "id long, tags array<string>, m map<string,int>, text string")
    got = ch.chunk_text(df, size=60, overlap=10)
    assert got.columns == ["id", "tags", "m", "chunk_index", "chunk_start", "chunk_end", "chunk"]
    rows = got.collect()
    assert {(r["id"], tuple(r["tags"] or ())) for r in rows} == {(1, ("p",)), (None, ())}
    assert ch.chunk_text(df, size=60, overlap=10, keep=[]).columns == ["chunk_index", "chunk_start", "chunk_end", "chunk"]
    assert ch.chunk_text(df, size=60, overlap=10, keep=[]).count() == len(rows)
