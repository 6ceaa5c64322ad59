"""Scans of many small files are few tasks."""
from contextlib import contextmanager

from tessera.sources import readers as rd
from tessera.streaming.incremental import stream_text_files


@contextmanager
def one_file_a_split(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4m")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _files(tmp_path, n):
    (tmp_path / "in").mkdir()
    for k in range(n):
        (tmp_path / "in" / f"{k}.txt").write_text(f"text number {k}")
    return str(tmp_path / "in")


def test_binary_files_in_few_tasks(spark, tmp_path):
    at = _files(tmp_path, 90)
    with one_file_a_split(spark):
        files = rd.read_binary_files(spark, at)
        assert files.rdd.getNumPartitions() <= rd.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
        assert sorted(r["content"].decode() for r in files.select("content").collect()) == sorted(f"text number {k}" for k in range(90))


def test_a_micro_batch_in_few_tasks(spark, tmp_path):
    at = _files(tmp_path, 90)
    with one_file_a_split(spark):
        stream_text_files(spark, at, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").select("path").distinct().count() == 90
    assert len(list((tmp_path / "out" / "batch_id=0").glob("part-*"))) <= 64


def test_pages_of_many_files_keep_errors_in_place(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(b"a\fb\fc" if k % 2 else b"a\f\xff")

    def extractor():
        def pages(content):
            for p in content.split(b"\f"):
                yield p.decode("utf-8")
        return pages

    rows = rd.read_pdf_pages(spark, str(tmp_path / "in"), extractor, with_errors=True).collect()
    found = {(r["path"][-5], r["page_num"], r["text"], r["error"] is None) for r in rows}
    assert found == {(str(k), n, t, True) for k in (1, 3, 5) for n, t in ((1, "a"), (2, "b"), (3, "c"))} | {
        (str(k), *rest) for k in (0, 2, 4) for rest in ((1, "a", True), (None, None, False))}


def test_tasks_list_what_spark_lists(spark, tmp_path):
    """Paths, times, sizes and bytes are those of Spark's own scan, hidden and empty files left out."""
    for name in ("a.txt", "b.TXT", "_no.txt", ".no.txt", "p=1/c d.txt", "_k=1.txt", "deep/er/é.txt", "_gone/x.txt", ".gone/x.txt", "z.pdf", "empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name.startswith("empty") else name.encode() * 9)
    glob = "*.[tT][xX][tT]"
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for own, theirs in ((rd.read_binary_files(spark, str(tmp_path), glob), scan.option("pathGlobFilter", glob).load(str(tmp_path))),
                        (rd.read_binary_files(spark, f"file://{tmp_path}/"), spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)))):
        rows = [sorted((r["path"], r["modificationTime"], r["length"], bytes(r["content"])) for r in df.collect()) for df in (own, theirs)]
        assert own.dtypes == theirs.dtypes and rows[0] == rows[1] and len(rows[0]) in (5, 6)


def test_the_driver_lists_no_files(spark, tmp_path, monkeypatch):
    at = _files(tmp_path, 30)
    files = rd.read_binary_files(spark, at)
    assert not [f for f in files.inputFiles() if f.endswith(".txt")]
    paths = files.select("path")  # where content is not used, no file is read
    for k in range(30):
        (tmp_path / "in" / f"{k}.txt").unlink()
    assert paths.count() == 30 and rd.split_by_extension(files)["txt"].select("path").count() == 30


def test_content_leaves_in_bounded_batches(tmp_path):
    import pandas as pd

    from tessera.sources import listing

    for k in range(6):
        (tmp_path / f"{k}.bin").write_bytes(b"%d" % k * (listing.CONTENT_BYTES // 2))
    out = list(listing._contents(iter([pd.Series([f"file:{tmp_path}/{k}.bin" for k in range(6)])])))
    assert [len(b) for b in out] == [2, 2, 2] and [bytes(x[:1]) for b in out for x in b] == [b"%d" % k for k in range(6)]


def test_paths_that_only_spark_lists(spark, tmp_path):
    at = _files(tmp_path, 3)
    assert rd.read_binary_files(spark, f"{at}/1.txt").count() == 1
    assert rd.read_binary_files(spark, f"{at}/*.txt").count() == 3
    assert rd.read_binary_files(spark, at, "{1,2}.txt").count() == 2
