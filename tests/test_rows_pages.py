import pytest

from tessera.functions import text as tx
from tessera.operators import pages as pg
from tessera.operators import rows as rw


def test_row_index_multi_file(spark, tmp_out):
    spark.range(0, 5).selectExpr("id", "cast(id as string) as text").coalesce(1).write.parquet(f"{tmp_out}/a")
    spark.range(5, 12).selectExpr("id", "cast(id as string) as text").coalesce(1).write.parquet(f"{tmp_out}/b")
    df = spark.read.parquet(f"{tmp_out}/a", f"{tmp_out}/b")
    got = sorted((r.real_index, r.id) for r in rw.with_row_index(df).collect())
    assert [g[0] for g in got] == list(range(12))
    # rows of one file are consecutive and in file order
    assert [g[1] for g in got] == list(range(12))


def test_row_index_non_parquet(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "text string").repartition(2)
    assert sorted(r.real_index for r in rw.with_row_index(df).collect()) == [0, 1, 2]


def test_slice_rows(spark):
    df = rw.with_row_index(spark.createDataFrame([(str(i),) for i in range(10)], "text string").coalesce(1))
    assert rw.slice_rows(df, 3, 4).count() == 4
    assert rw.slice_rows(df, 3, 0).count() == 7         # 0 means all
    assert rw.slice_rows(df, 8, 100).count() == 2
    with pytest.raises(ValueError):
        rw.slice_rows(df, 10)
    with pytest.raises(ValueError):
        rw.slice_rows(df, -1)


def test_dataset_chunks_and_validation(spark):
    rows = [(0, "valid text here"), (1, None), (2, "   "), (3, "123456789"), (4, "1234567890")]
    df = spark.createDataFrame(rows, "real_index long, text string")
    got = sorted((r.real_index, r.chunk) for r in rw.dataset_chunks(df).collect())
    assert [g[0] for g in got] == [0, 4]
    assert got[1][1] == tx.DATASET_CHUNK_HEADER + "1234567890" + tx.DATASET_CHUNK_FOOTER
    with pytest.raises(ValueError, match="it has real_index, text"):
        rw.dataset_chunks(df, text_col="body")
    # non-string text columns are skipped, not cast
    nums = spark.createDataFrame([(0, 12345678901)], "real_index long, text long")
    assert rw.dataset_chunks(nums).count() == 0


@pytest.fixture
def pages(spark):
    rows = [(1, 1, "first  page"), (1, 2, "  \n "), (1, 3, "third\tpage"), (2, 1, ""), (2, 2, " ")]
    return spark.createDataFrame(rows, "doc long, page_num int, text string")


def test_join_pages_and_stats(spark, pages):
    got = {r.doc: r.text for r in pg.join_pages(pages, ["doc"]).collect()}
    rule = "=" * 50
    assert got[1] == rule + "\n\n=== PAGE 1 ===\n\nfirst page\n\n\n\n=== PAGE 3 ===\n\nthird page\n\n" + rule
    assert got[2] == ""
    st = {r.doc: r for r in pg.page_stats(pages, ["doc"]).collect()}
    assert (st[1].pages_total, st[1].pages_with_text, st[1].total_chars) == (3, 2, len(got[1]))
    assert st[2].avg_chars_per_page == 0.0


@pytest.mark.parametrize("max_pages,expected", [(0, 3), (None, 3), (1, 1), (10, 3)])
def test_page_limit(spark, pages, max_pages, expected):
    assert pg.page_limit(pages.filter("doc = 1"), max_pages).count() == expected


def test_keep_and_drop_blank(spark, pages):
    kept = {(r.doc, r.page_num): r.text for r in pg.pages_keep_blank(pages).collect()}
    assert kept[(1, 2)] == "" and kept[(1, 1)] == "first  page"
    assert pg.pages_drop_blank(pages).count() == 2


def test_pages_from_text_layer(spark):
    df = spark.createDataFrame([(1, "p one\fp two\f\fp four")], "doc long, text string")
    got = [(r.page_num, r.text) for r in pg.pages_from_text_layer(df, ["doc"]).orderBy("page_num").collect()]
    assert got == [(1, "p one"), (2, "p two"), (3, ""), (4, "p four")]
    joined = pg.join_pages(pg.pages_from_text_layer(df, ["doc"]), ["doc"], max_pages=2).first().text
    assert "=== PAGE 2 ===" in joined and "p four" not in joined


def test_dense_numbers_of_two_million_rows(spark):
    df = spark.range(0, 2_000_000, 1, 8).selectExpr("xxhash64(id) as k", "id")
    r = rw.zip_index(df, "n", ["k", "id"]).selectExpr("count(distinct n) as d", "min(n) as a", "max(n) as b").first()
    assert (r.d, r.a, r.b) == (2_000_000, 0, 1_999_999)


def _expected(rows):
    return [(n, i) for n, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_positions_over_unequal_files_and_filters(spark, tmp_out, fmt):
    sizes = (3, 997, 100, 1)
    start = 0
    for k, n in enumerate(sizes):
        spark.range(start, start + n).selectExpr("id", "if(id % 2 = 0, 'train', 'test') as split").coalesce(1).write.format(fmt).option(
            "header", True).mode("append").save(f"{tmp_out}/{fmt}/part={k}")
        start += n
    reader = spark.read.option("header", True).option("inferSchema", True).format(fmt)
    df = reader.load(f"{tmp_out}/{fmt}").select("id", "split")
    rows = [(i, i % 2) for i in range(start)]
    got = sorted((r.real_index, r.id) for r in rw.with_row_index(df).collect())
    assert got == _expected(rows)
    half = rw.with_row_index(df.filter("split = 'train'"))
    assert sorted((r.real_index, r.id) for r in half.collect()) == _expected([x for x in rows if x[1] == 0])
    assert rw.slice_rows(half, 0, 10).count() == 10
    if fmt == "parquet":
        assert sorted((r.real_index, r.id) for r in rw.with_row_index(df, bare_scan=True).collect()) == _expected(rows)
