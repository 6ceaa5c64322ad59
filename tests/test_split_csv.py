import csv
import random

import pytest

from tessera.sources import split_csv as sc
from tessera.sources.readers import read_table

COLUMNS = ["id", "text", "note"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def write(path, records, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(COLUMNS)
        w.writerows(records)


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "3"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_of_the_one_task_reader(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    parts = ["plain", "a,b", "line\nend", "\n\n", 'say "yes"', '"', "ü", "x" * 150, "\n" * 40, "tail\n"]
    for k in range(2):
        write(f"{tmp_path}/{k}.csv", [(100 * k + i, "".join(rng.choices(parts, k=rng.randint(1, 4))), rng.choice(parts)) for i in range(60)])
    got = sc.read_csv_split(spark, str(tmp_path), "id int, text string, note string")
    want = read_table(spark, str(tmp_path), "csv", schema="id int, text string, note string")
    assert rows(got) == rows(want)
    assert len(rows(got)) == 120
    lines = sc._lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20 and len(sc.open_splits(lines)) > 5


def test_line_ends_and_schema(spark, tmp_path, small_splits):
    write(f"{tmp_path}/a.csv", [(1, "x" * 200, "u"), (2, "y", "a\nb")], end="\r\n")
    assert rows(sc.read_csv_split(spark, str(tmp_path))) == [("1", "x" * 200, "u"), ("2", "y", "a\nb")]
    assert sc.read_csv_split(spark, str(tmp_path), "note string, id long, text string").columns == ["note", "id", "text"]
    with pytest.raises(ValueError, match="columns id, text, note"):
        sc.read_csv_split(spark, str(tmp_path), "id int")


def test_header_only_and_open_end(spark, tmp_path):
    write(f"{tmp_path}/a.csv", [])
    assert sc.read_csv_split(spark, str(tmp_path)).collect() == []
    (tmp_path / "b.csv").write_text('id,text,note\n1,"never closed,2\n')
    assert [r.record for r in sc.csv_records(spark, f"{tmp_path}/b.csv").collect()] == ['1,"never closed,2']


def test_any_column_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('my id:x,"a, b",`c.d`\n1,"p\nq",r\n')
    df = sc.read_csv_split(spark, str(tmp_path))
    assert df.columns == ["my id:x", "a, b", "`c.d`"]
    assert [tuple(r) for r in df.collect()] == [("1", "p\nq", "r")]


def test_lines_cross_to_python_once(spark, tmp_path, small_splits):
    write(f"{tmp_path}/a.csv", [(i, "line\nend" * 30, "u") for i in range(9)])
    df = sc.read_csv_split(spark, str(tmp_path))
    assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert rows(df) == sorted((str(i), "line\nend" * 30, "u") for i in range(9))
    named = sc.csv_records(spark, str(tmp_path))
    assert named.select("file").distinct().count() == 1 and named.count() == 9
