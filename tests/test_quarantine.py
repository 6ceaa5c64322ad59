import os

import pytest
from pyspark.sql import types as T

from tessera.operators import generate as gn
from tessera.plans import flows
from tessera.sources import quarantine as qr


def put(root, name, text):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_good_broken_wider_and_malformed(spark, tmp_out):
    good = put(tmp_out, "good.jsonl", '{"id": 1, "text": "one"}\n{"id": 2, "text": \n{"id": 3, "text": "three"}\n')
    wide = put(tmp_out, "wide.csv", 'id,text,score\n4,"four, and\nmore",0.5\n5,five,x\n')
    broken = put(tmp_out, "broken.parquet", "no parquet")
    other = put(tmp_out, "other.csv", "a,b\n1,2\n")
    rows, errors = qr.read_quarantined(spark, [good, wide, broken, other, f"{tmp_out}/gone.csv"], f"{tmp_out}/out", require=["text"])
    got = sorted((r["id"], r["text"], r["score"], os.path.basename(r[qr.PATH])) for r in rows.collect())
    assert got == [(1, "one", None, "good.jsonl"), (3, "three", None, "good.jsonl"), (4, "four, and\nmore", "0.5", "wide.csv"), (5, "five", "x", "wide.csv")]
    found = sorted((os.path.basename(r["path"]), r["kind"], r["record"]) for r in errors.collect())
    assert found == [("broken.parquet", "input", None), ("gone.csv", "input", None), ("good.jsonl", "record", '{"id": 2, "text": '), ("other.csv", "input", None)]
    assert "no column 'text'" in next(r["error"] for r in errors.collect() if r["path"].endswith("other.csv"))


def test_a_broken_file_among_many_stands_alone(spark, tmp_out):
    for i in range(9):
        spark.createDataFrame([(i, f"t{i}")], "id int, text string" if i % 2 else "id long, text string").coalesce(1).write.parquet(f"{tmp_out}/in/{i}")
    put(tmp_out, "in/5b/x.parquet", "PAR1 broken PAR1")
    rows, errors = qr.read_quarantined(spark, [f"{tmp_out}/in"], f"{tmp_out}/out")
    assert sorted(tuple(r)[:2] for r in rows.collect()) == [(i, f"t{i}") for i in range(9)]
    assert [os.path.basename(r["path"]) for r in errors.collect()] == ["x.parquet"]


def test_csv_files_of_different_headers_are_not_misread(spark, tmp_out):
    put(tmp_out, "in/a.csv", "id,text\n1,one\n")
    put(tmp_out, "in/b.csv", "text,id,more\ntwo,2,x\n")
    rows, errors = qr.read_quarantined(spark, [f"{tmp_out}/in"], f"{tmp_out}/out")
    assert sorted((r["id"], r["text"], r["more"]) for r in rows.collect()) == [(1, "one", None), (2, "two", "x")] and errors.count() == 0


@pytest.mark.parametrize("a,b,want", [
    ("int", "bigint", "bigint"), ("bigint", "double", "double"), ("int", "float", "double"), ("smallint", "float", "float"), ("date", "timestamp", "timestamp"),
    ("string", "bigint", "string"), ("boolean", "int", "string"), ("void", "date", "date"), ("decimal(10,2)", "decimal(12,4)", "decimal(12,4)"),
    ("decimal(38,0)", "decimal(38,10)", "double"), ("array<int>", "array<bigint>", "array<bigint>"), ("array<int>", "string", "string"),
    ("struct<a:int,b:string>", "struct<b:string,c:date,a:double>", "struct<a:double,b:string,c:date>")])
def test_type_lattice(spark, a, b, want):
    ta, tb = (spark.sql(f"select cast(null as {t}) as x").schema["x"].dataType for t in (a, b))
    assert qr.wider(ta, tb).simpleString() == want
    if "struct" not in a:
        assert qr.wider(tb, ta).simpleString() == want


def test_nested_values_conform(spark):
    a = spark.sql("select named_struct('a', 1, 'b', 'x') as s, array(1, 2) as v, 7 as ID")
    b = spark.sql("select named_struct('b', 'y', 'c', 2.5D) as s, 'text' as v, 8L as id")
    schema = qr.merged_schema([a.schema, b.schema])
    got = [r.asDict(True) for df in (a, b) for r in qr.conformed(df, schema).collect()]
    assert got == [{"s": {"a": 1, "b": "x", "c": None}, "v": "[1,2]", "ID": 7}, {"s": {"a": None, "b": "y", "c": 2.5}, "v": "text", "ID": 8}]


def test_nothing_readable(spark, tmp_out):
    rows, errors = qr.read_quarantined(spark, [put(tmp_out, "x.parquet", "?")], f"{tmp_out}/out", require=["text"])
    assert rows.collect() == [] and rows.columns == ["text", qr.PATH] and errors.count() == 1
    rows, errors = qr.read_quarantined(spark, [], f"{tmp_out}/out2")
    assert rows.collect() == [] and errors.schema == T._parse_datatype_string(qr.ERRORS)


def test_table_flow_over_several_sources(spark, tmp_out):
    good = put(tmp_out, "good.jsonl", '{"id": 1, "text": "one text of its own."}\n{"id": \n')
    wide = put(tmp_out, "wide.csv", "id,text,score\n4,four texts of their own.,0.5\n")
    broken = put(tmp_out, "broken.parquet", "no parquet")
    out = flows.build_from_tables(spark, [good, broken, wide], f"{tmp_out}/o", generator_factory=gn.FirstSentenceGenerator, n_questions=1, output_format="json", run="r")
    assert out["summary"]["text_chunks"] == 2 and out["summary"]["qa_pairs"] == 2 and out["input_errors"] == 2
    kinds = sorted((r["kind"], os.path.basename(r["path"])) for r in spark.read.parquet(out["input_errors_parquet"]).collect())
    assert kinds == [("input", "broken.parquet"), ("record", "good.jsonl")]
    with pytest.raises(ValueError, match="nothing could be read"):
        flows.build_from_tables(spark, [broken], f"{tmp_out}/o2")
