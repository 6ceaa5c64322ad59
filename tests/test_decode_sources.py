import os

import pytest

from tessera.functions.decode import decode_text
from tessera.sources import readers as rd

BYTES = [
    "ما هي العاصمة؟".encode("utf-8"),
    b"\xef\xbb\xbfBOM first",
    b"\xc7\xe1 cp1256",
    b"one\r\ntwo\rthree\n",
    b"   \n\t ",
    " ".encode("utf-8"),
    b"bad \xff\xfe utf8 \xc7\xe1",
    b"\xa0\xa0",
]


def test_decode_cascade_matches_python(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BYTES)], "i int, b binary")
    got = [r[0] for r in df.orderBy("i").select(decode_text("b")).collect()]
    # UTF-8 (the byte order mark is a character of it), then cp1256 for the third and the last two;
    # blank text falls through to the lenient UTF-8 reading, where the last two bytes are lost
    assert got[:6] == ["ما هي العاصمة؟", "\ufeffBOM first", "ال cp1256", "one\ntwo\nthree\n", "   \n\t ", "آ\xa0"]
    assert got[6].startswith("bad ") and got[6].endswith(" utf8 ال")
    assert got[7] == ""


def test_read_text_files(spark, tmp_out):
    d = os.path.join(tmp_out, "txt")
    os.makedirs(os.path.join(d, "sub"))
    files = {"a.txt": "line one\r\n\r\n  second   line \r\n", "sub/b.txt": "", "c.txt": "   \n  ",
             "d.md": "not read", "e.txt": "x"}
    for name, body in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8", newline="") as f:
            f.write(body)
    with open(os.path.join(d, "f.txt"), "wb") as f:
        f.write("العربية".encode("cp1256"))
    got = {os.path.basename(r.path): r.text for r in rd.read_text_files(spark, d).collect()}
    assert "b.txt" not in got            # zero-byte file: no row (documented deviation)
    assert "d.md" not in got
    banner, rule = "=" * 50 + "\nTEXT DOCUMENT\n" + "=" * 50 + "\n\n", "\n\n" + "=" * 50
    assert got["a.txt"] == banner + "line one\n\nsecond line\n" + rule
    assert got["c.txt"] == banner + "\n" + rule  # blank file keeps the banner
    assert got["f.txt"] == banner + "العربية" + rule


def test_detect_format():
    assert rd.detect_format("x.CSV") == "csv"
    assert rd.detect_format("x.jsonl") == "json"
    assert rd.detect_format("x.parquet") == "parquet"
    assert rd.detect_format("x.tsv") == "csv"
    with pytest.raises(ValueError):
        rd.detect_format("x", "xml")


def test_read_table_formats(spark, tmp_out):
    rows = [(0, 'say "hi",\nthen go', "en"), (1, "  padded  ", "fr")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    df.write.csv(f"{tmp_out}/t.csv", header=True, escape='"', ignoreLeadingWhiteSpace=False,
                 ignoreTrailingWhiteSpace=False)
    df.write.json(f"{tmp_out}/t.jsonl")
    with open(f"{tmp_out}/arr.json", "w") as f:
        f.write('[{"id": 0, "text": "a"}, {"id": 1, "text": "b"}]')
    for path in (f"{tmp_out}/t.csv", f"{tmp_out}/t.jsonl"):
        got = sorted((int(r.id), r.text) for r in rd.read_table(spark, path).collect())
        assert got == [(0, rows[0][1]), (1, rows[1][1])]
    assert sorted(r.text for r in rd.read_table(spark, f"{tmp_out}/arr.json", json_array=True).collect()) == ["a", "b"]


def test_dataset_info(spark):
    df = spark.createDataFrame([(1, "x" * 150, 2.5), (0, "short", None)], "id long, text string, v double")
    r = rd.dataset_info(df, "demo", order_col="id", text_col="text").first()
    assert r.total_samples == 2 and r.columns == ["id", "text", "v"] and r.text_column_exists
    assert r.features == {"id": "bigint", "text": "string", "v": "double"}
    assert r.sample_data == {"id": "0", "text": "short", "v": None}


def test_split_by_extension(spark, tmp_out):
    for n in ("a.TXT", "b.PDF", "c.docx"):
        with open(os.path.join(tmp_out, n), "w") as f:
            f.write("x")
    parts = rd.split_by_extension(rd.read_binary_files(spark, tmp_out))
    assert [parts[k].count() for k in ("txt", "pdf", "unsupported")] == [1, 1, 1]


def test_pdf_pages_plugin(spark, tmp_out):
    with open(os.path.join(tmp_out, "doc.pdf"), "wb") as f:
        f.write(b"page one\fpage two\f\fpage four")

    def factory():
        return lambda data: data.decode().split("\f")

    pages = rd.read_pdf_pages(spark, tmp_out, factory, max_pages=3).orderBy("page_num").collect()
    assert [(p.page_num, p.text) for p in pages] == [(1, "page one"), (2, "page two"), (3, "")]


def test_document_path_checks(spark, tmp_out):
    with pytest.raises(FileNotFoundError):
        rd.check_document_path(spark, f"{tmp_out}/missing.txt")
    p = os.path.join(tmp_out, "notes.docx")
    with open(p, "w") as f:
        f.write("x")
    with pytest.raises(ValueError, match="not docx"):
        rd.check_document_path(spark, p)
    rd.check_document_path(spark, tmp_out)  # a folder is fine


def test_dataset_info_first_row_in_file_order(spark, tmp_out):
    spark.range(0, 1000, 1, 4).selectExpr("id", "concat('t', id) as text").coalesce(1) \
        .write.parquet(f"{tmp_out}/one")
    df = spark.read.parquet(f"{tmp_out}/one").repartition(7)  # shuffled: limit(1) could pick any row
    r = rd.dataset_info(spark.read.parquet(f"{tmp_out}/one"), "one").first()
    assert r.sample_data["id"] == "0"
    assert rd.dataset_info(df, "shuffled").first().total_samples == 1000


def test_read_table_sampling_ratio(spark, tmp_out):
    spark.range(200).selectExpr("id", "concat('x', id) as text").write.json(f"{tmp_out}/s.jsonl")
    df = rd.read_table(spark, f"{tmp_out}/s.jsonl", sampling_ratio=0.5)
    assert df.count() == 200 and set(df.columns) == {"id", "text"}


def test_upper_case_suffixes_and_failing_files(spark, tmp_out):
    for name, body in (("A.PDF", b"one\ftwo"), ("b.pdf", b"boom"), ("T.TXT", b"text")):
        with open(os.path.join(tmp_out, name), "wb") as f:
            f.write(body)

    def factory():
        def extract(data):
            if data == b"boom":
                raise RuntimeError("broken file")
            return data.decode().split("\f")
        return extract

    rows = rd.read_pdf_pages(spark, tmp_out, factory, with_errors=True).collect()
    assert sorted((os.path.basename(r.path), r.page_num, r.text) for r in rows if r.error is None) == [("A.PDF", 1, "one"), ("A.PDF", 2, "two")]
    assert [(os.path.basename(r.path), r.page_num) for r in rows if r.error] == [("b.pdf", None)]
    assert rd.read_text_files(spark, tmp_out).count() == 1
    with pytest.raises(Exception, match="broken file"):
        rd.read_pdf_pages(spark, tmp_out, factory).count()
