import csv
import glob
import json
import os

from pyspark.sql import functions as F

from tessera.operators import combine as cb
from tessera.operators import embed as em
from tessera.operators import generate as gn
from tessera.plans import flows
from tessera.sources import sinks as sk


def _read_json_dir(path):
    rows = []
    for p in sorted(glob.glob(f"{path}/part-*")):
        with open(p, encoding="utf-8") as f:
            rows += [json.loads(line) for line in f if line.strip()]
    return rows


def test_json_csv_round_trip(spark, tmp_out):
    df = spark.createDataFrame([("q\n\"x\"", None, 1), ("é ؟", "b", 2)], "question string, answer string, n int")
    sk.write_json(df, f"{tmp_out}/j")
    assert sorted(_read_json_dir(f"{tmp_out}/j"), key=lambda r: r["n"])[0] == {"question": "q\n\"x\"",
                                                                              "answer": None, "n": 1}
    sk.write_csv(df, f"{tmp_out}/c")
    rows = []
    for p in glob.glob(f"{tmp_out}/c/part-*.csv"):
        with open(p, encoding="utf-8", newline="") as f:
            rows += list(csv.DictReader(f))
    assert list(rows[0].keys()) == ["answer", "n", "question"]    # sorted header
    assert sorted(r["question"] for r in rows) == sorted(["q\n\"x\"", "é ؟"])
    assert sk.write_csv(df.filter(F.lit(False)), f"{tmp_out}/empty") is None
    assert not os.path.exists(f"{tmp_out}/empty")


def test_write_files_idempotent(spark, tmp_out):
    files = spark.createDataFrame([("a.txt", "x"), ("sub/b.json", "{}")], "file_name string, body string")
    assert sk.write_files(files, f"{tmp_out}/f") == 2
    assert sk.write_files(files, f"{tmp_out}/f") == 2
    assert open(f"{tmp_out}/f/sub/b.json").read() == "{}"


def test_union_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id long, text string")
    b = spark.createDataFrame([("y", "en")], "text string, lang string")
    u = cb.union_missing_cols([a, b])
    assert u.columns == ["id", "lang", "text"] and u.count() == 2
    ok, errors = cb.read_many(["/nonexistent/x.parquet"], lambda p: spark.read.parquet(p))
    assert ok is None and len(errors) == 1


def test_document_flow_end_to_end(spark, tmp_out):
    src = os.path.join(tmp_out, "in")
    os.makedirs(src)
    texts = {"one.txt": "First sentence here. " * 80, "two.txt": "Другой текст! " * 30}
    for n, t in texts.items():
        with open(os.path.join(src, n), "w", encoding="utf-8") as f:
            f.write(t)
    out = flows.build_from_documents(spark, src, os.path.join(tmp_out, "out"), gn.FirstSentenceGenerator,
                                     lambda: em.HashingEncoder(16), n_questions=2, save_individual=True, datapoint_files=True)
    expected_chunks = 3 + 1  # 1,680 characters and the banner's title in windows of 1000; one window for the short text
    assert out["summary"]["text_chunks"] == expected_chunks
    assert out["summary"]["qa_pairs"] == 2 * expected_chunks
    assert out["summary"]["embeddings"] == expected_chunks
    assert out["chunk_progress"]["rows"] == expected_chunks
    alpaca = _read_json_dir(out["alpaca"])
    assert len(alpaca) == 2 * expected_chunks and set(alpaca[0]) == {"instruction", "input", "output"}
    assert len(glob.glob(out["alpaca_datapoints"] + "/datapoint_*.json")) == 2 * expected_chunks
    assert os.path.exists(os.path.join(out["individual"], "one.txt", "chunk_0000.txt"))
    assert os.path.exists(os.path.join(out["individual"], "two.txt", "chunk_0000_qa_01.json"))
    meta = _read_json_dir(out["metadata"])[0]
    assert meta["dataset_info"]["total_qa_pairs"] == 2 * expected_chunks
    vec = spark.read.parquet(out["embeddings"])
    assert vec.count() == expected_chunks and set(vec.columns) == {"path", "chunk_index", "embedding"}


def test_table_flow_slice(spark, tmp_out):
    rows = [(i, f"row number {i} has some text." if i != 3 else "short") for i in range(8)]
    spark.createDataFrame(rows, "id long, body string").coalesce(1).write.parquet(f"{tmp_out}/t.parquet")
    out = flows.build_from_table(spark, f"{tmp_out}/t.parquet", f"{tmp_out}/o", text_col="body",
                                 start_index=2, max_samples=4, generator_factory=gn.FirstSentenceGenerator,
                                 n_questions=1, output_format="json", save_individual=True)
    # rows 2..5; row 3 is under 10 characters after cleaning
    assert out["summary"]["text_chunks"] == 3 and out["summary"]["qa_pairs"] == 3
    ids = sorted(r["id"] for r in _read_json_dir(out["instructions_json"]))
    assert ids == ["dataset_2_question_0", "dataset_4_question_0", "dataset_5_question_0"]
    assert os.path.exists(os.path.join(out["individual"], "file_chunk_000004.txt"))
    assert os.path.exists(os.path.join(out["individual"], "file_chunk_000004_qa_00.json"))


def _inputs(root, files):
    for name, body in files.items():
        p = os.path.join(root, name)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(body)
    return root


def test_same_named_documents_stay_apart(spark, tmp_out):
    src = _inputs(f"{tmp_out}/in", {"a/r.txt": b"Text of a. " * 5, "b/r.txt": b"Text of b. " * 5})
    out = flows.build_from_documents(spark, src, f"{tmp_out}/out", gn.FirstSentenceGenerator, n_questions=1, save_individual=True,
                                     datapoint_files=True, run="one")
    for d in ("a", "b"):
        body = open(os.path.join(out["individual"], d, "r.txt", "chunk_0000.txt"), encoding="utf-8").read()
        assert f"Text of {d}." in body
    assert len(os.listdir(out["alpaca_datapoints"])) >= 2


def test_unreadable_inputs_are_reported(spark, tmp_out):
    src = _inputs(f"{tmp_out}/in", {"x.md": b"?", "p.PDF": b"boom", "q.pdf": b"page", "t.TXT": b"Some text here."})

    def factory():
        def extract(data):
            if data == b"boom":
                raise RuntimeError("broken")
            return [data.decode()]
        return extract

    out = flows.build_from_documents(spark, src, f"{tmp_out}/out", pdf_extractor_factory=factory)
    assert out["input_errors"] == 2 and out["summary"]["text_chunks"] == 2
    errors = {os.path.basename(r.path): r.error for r in spark.read.parquet(out["input_errors_parquet"]).collect()}
    assert errors.keys() == {"x.md", "p.PDF"} and "broken" in errors["p.PDF"]
    import pytest

    with pytest.raises(ValueError, match="no PDF extractor"):
        flows.build_from_documents(spark, f"{src}/q.pdf", f"{tmp_out}/o2")


def test_a_named_run_resumes(spark, tmp_out):
    rows = [(i, f"row number {i} has some text.") for i in range(6)]
    spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(f"{tmp_out}/t.parquet")
    args = dict(generator_factory=gn.FirstSentenceGenerator, n_questions=2, output_format="json", run="mine")
    first = flows.build_from_table(spark, f"{tmp_out}/t.parquet", f"{tmp_out}/o", max_samples=4, **args)
    assert first["summary"]["qa_pairs"] == 8

    class Never:
        def generate(self, prompts, **_):
            if any(f"number {i} " in p for p in prompts for i in range(4)):
                raise RuntimeError("asked again")
            return ["x"] * len(prompts)

    second = flows.build_from_table(spark, f"{tmp_out}/t.parquet", f"{tmp_out}/o", **(args | {"generator_factory": Never}))
    assert second["summary"]["qa_pairs"] == 12 and second["errors"] == 0
    ids = [r["id"] for r in _read_json_dir(second["instructions_json"])]
    assert len(set(ids)) == len(ids) == 12


def test_paths_without_a_scheme_are_qualified(spark):
    assert sk.qualified(spark, "/some/where") == "file:/some/where"
    assert sk.qualified(spark, "rel").startswith("file:/")
