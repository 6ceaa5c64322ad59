import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import generate as gn
from tessera.operators import journal as jn


class Recording(gn.FirstSentenceGenerator):
    """Answers, writes down every context that it is asked about, fails on ``bad`` and dies on ``deadly``."""

    def __init__(self, log, bad=(), deadly=()):
        self.log, self.bad, self.deadly = log, bad, deadly

    def generate(self, prompts, **options):
        for p in prompts:
            context = p.split(gn.TEXT_MARKER, 1)[1].split(gn.QUESTION_MARKER)[0]
            if any(d in context for d in self.deadly):
                os._exit(3)  # the worker is gone, with all it had not committed
            if any(b in context for b in self.bad):
                raise RuntimeError("model failed")
        with open(os.path.join(self.log, f"{os.getpid()}"), "a") as f:
            f.writelines(p.split(gn.TEXT_MARKER, 1)[1].split(gn.QUESTION_MARKER)[0] + "\n" for p in prompts)
        return super().generate(prompts, **options)


def chunks_of(spark, n):
    return spark.createDataFrame([(i, f"Context {i} here. More.") for i in range(n)], "real_index long, chunk string")


def asked(log):
    out = []
    for f in glob.glob(f"{log}/*"):
        out += open(f).read().split("\n")[:-1]
    return out


def log_dir(root, name):
    os.makedirs(f"{root}/{name}")
    return f"{root}/{name}"


def run(spark, chunks, path, gen, **options):
    return jn.generate_journalled(chunks, lambda: gen, path, ["real_index"], n_questions=2, **({"questions_per_task": 4} | options))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_killed_job_resumes_where_its_tasks_stopped(spark, tmp_out):
    chunks, path = chunks_of(spark, 40), f"{tmp_out}/journal"
    one, two = log_dir(tmp_out, "one"), log_dir(tmp_out, "two")
    with pytest.raises(Exception):
        run(spark, chunks, path, Recording(one, deadly=["Context 17 "])).collect()
    assert not os.path.exists(f"{path}/run=1/_SUCCESS")
    kept = spark.read.parquet(f"{path}/run=1").select("chunk_index").distinct().count()
    assert 0 < kept < 40
    got = run(spark, chunks, path, Recording(two), with_run=True)
    want = gn.generate_qa(chunks, gn.FirstSentenceGenerator, n_questions=2)
    assert rows(got.drop("run")) == rows(want)
    # what a finished task had journalled is not asked again
    again = set(asked(two))
    assert len(again) == 40 - kept and len(asked(two)) == 4 * len(again)
    assert {r["run"] for r in got.collect()} == {1, 2}


def test_failed_rows_are_asked_again_and_the_last_success_wins(spark, tmp_out):
    chunks, path = chunks_of(spark, 12), f"{tmp_out}/journal"
    first = run(spark, chunks, path, Recording(log_dir(tmp_out, "one"), bad=["Context 3 ", "Context 7 "])).collect()
    assert sum(r["error"] is not None for r in first) == 4 and len(first) == 24
    still = run(spark, chunks, path, Recording(log_dir(tmp_out, "two"), bad=["Context 7 "])).collect()
    assert sum(r["error"] is not None for r in still) == 2 and set(asked(f"{tmp_out}/two")) == {"Context 3 here. More."}
    got = run(spark, chunks, path, Recording(log_dir(tmp_out, "three")))
    assert rows(got) == rows(gn.generate_qa(chunks, gn.FirstSentenceGenerator, n_questions=2))
    assert set(asked(f"{tmp_out}/three")) == {"Context 7 here. More."}
    assert rows(run(spark, chunks, path, Recording(log_dir(tmp_out, "four")))) == rows(got) and asked(f"{tmp_out}/four") == []


def test_changed_prompts_options_and_questions_are_asked(spark, tmp_out):
    chunks, path = chunks_of(spark, 3), f"{tmp_out}/journal"
    run(spark, chunks, path, Recording(log_dir(tmp_out, "one"))).collect()
    two = Recording(log_dir(tmp_out, "two"))
    more = jn.generate_journalled(chunks, lambda: two, path, ["real_index"], n_questions=3)
    assert sorted((r["chunk_index"], r["question_index"]) for r in more.collect()) == [(c, q) for c in range(3) for q in range(3)]
    assert len(asked(f"{tmp_out}/two")) == 3 * 2  # the third question of each
    run(spark, chunks, path, Recording(log_dir(tmp_out, "three")), answer_options={"temperature": 0.1}).collect()
    assert len(asked(f"{tmp_out}/three")) == 3 * 4
    changed = chunks.withColumn("chunk", F.when(F.col("real_index") == 1, F.lit("Another text.")).otherwise(F.col("chunk")))
    got = run(spark, changed, path, Recording(log_dir(tmp_out, "four"))).collect()
    assert set(asked(f"{tmp_out}/four")) == {"Another text."}
    assert {r["context"] for r in got if r["chunk_index"] == 1} == {"Another text."} and len(got) == 6


def test_defined_cases(spark, tmp_out):
    chunks = spark.createDataFrame([(0, None), (1, "Same."), (1, "Same."), (1, "Other.")], "real_index long, chunk string")
    got = run(spark, chunks, f"{tmp_out}/a", Recording(log_dir(tmp_out, "one"))).collect()
    assert sorted((str(r["chunk_index"]), str(r["context"]), r["error"]) for r in got if r["question_index"] == 0) == [
        ("0", "None", "no context"), ("1", "Other.", None), ("1", "Same.", None), ("1", "Same.", None)]
    assert len(asked(f"{tmp_out}/one")) == 2 * 4
    assert jn.generate_journalled(chunks, lambda: None, f"{tmp_out}/b", ["real_index"]).collect() == []
    assert run(spark, chunks.limit(0), f"{tmp_out}/c", None).collect() == []
    # a task committed twice
    path = f"{tmp_out}/a/run=1"
    spark.read.parquet(path).write.mode("append").parquet(path)
    assert len(run(spark, chunks, f"{tmp_out}/a", Recording(log_dir(tmp_out, "two"))).collect()) == 8 and asked(f"{tmp_out}/two") == []


def test_no_python_to_read_an_empty_journal(spark, tmp_out):
    schema = spark.createDataFrame([], "chunk_index long, answer string").schema
    none = jn.read_journal(spark, f"{tmp_out}/none", schema)
    assert none.columns == ["chunk_index", "answer", "run"] and none.collect() == []
    assert "ExistingRDD" not in none._jdf.queryExecution().toString()
