"""Generation that survives a dying job: every answer is journalled by the task that asked for it.

The journal is a folder of runs (``run=1``, ``run=2``, ...) of Parquet rows, each with the key of what was
asked: a hash of both templates, the options of both calls and the context. A run deals the
open questions into tasks of a bounded number of model calls, and each task's rows move
into the journal when that task commits (the committer's algorithm 2), not when the
job does: a job that is killed has lost at most the calls of its unfinished tasks.
Spark writes and reads the journal, so it lies on any store the session reaches.

Read back, the journal is merged: per chunk, question index and key the last success wins, else the last failure.
What has a success is not asked again; failures, and questions whose prompt or options
have changed, are. A task committed twice leaves two equal claims, of which one wins.

Defined cases: a null context is never sent, and stays a failure; without a model nothing is
journalled and nothing answered; chunks that are gone from the input stay in the
journal but not in the result; repeated chunk keys with different texts are kept
apart by the hash, equal ones are asked once and answered for each row."""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import generate as gn
from tessera.plans.parallel import SPREAD

#: Model calls lost at most with a task: two for each question.
QUESTIONS_PER_TASK = 512
ASKED = "asked"  # column: hash of what was asked
RUN = "run"


def asked_key(context, question_template: str, answer_template: str, question_options: dict, answer_options: dict) -> Column:
    """SHA-256 of the prompts' templates, the call options and the context (null: null context)."""
    frame = json.dumps([question_template, answer_template, question_options, answer_options], sort_keys=True, default=str, ensure_ascii=False)
    c = F.col(context) if isinstance(context, str) else context
    return F.sha2(F.concat(F.lit(frame + "\x00"), F.coalesce(F.concat(F.lit("="), c), F.lit(""))), 256)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _runs(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the runs in a journal."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{RUN}=") and n.partition("=")[2].isdigit())


def read_journal(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of all runs, those of a run that died included (no _SUCCESS is asked for), with the run's number."""
    out = None
    for n in _runs(spark, path):
        run = spark.read.schema(schema).parquet(f"{path}/{RUN}={n}").withColumn(RUN, F.lit(n).cast("long"))
        out = run if out is None else out.unionByName(run)
    if out is None:  # no rows, and no task in Python to make them
        out = spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields), F.lit(0).cast("long").alias(RUN))
    return out


def merged(journal: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, question index and asked hash: the last success, else the last failure."""
    by = [*keys, "question_index", ASKED]
    rest = [c for c in journal.columns if c not in by]
    claim = F.struct(F.col("error").isNull().alias("ok"), F.col(RUN).alias("at"), F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))
    best = journal.groupBy(*by).agg(F.max_by(F.struct(*rest), claim).alias("best"))
    return best.select(*by, "best.*")


def open_questions(chunks: DataFrame, done: DataFrame, keys: list[str], n_questions: int) -> DataFrame:
    """Each distinct (keys, asked) of chunks with the ``wanted`` question indexes that
    done (keys, asked, question_index) does not have."""
    by = [*keys, ASKED]
    answered = done.groupBy(*by).agg(F.collect_set("question_index").alias("answered"))
    every = F.array(*(F.lit(i) for i in range(max(0, n_questions)))).cast("array<int>")
    todo = chunks.dropDuplicates(by)
    joined = todo.join(answered.withColumnsRenamed({k: f"done_{k}" for k in by}),
                       [F.col(k).eqNullSafe(F.col(f"done_{k}")) for k in by], "left")
    wanted = F.array_except(every, F.coalesce("answered", F.array().cast("array<int>")))
    return joined.select(*todo.columns, wanted.alias("wanted")).filter(F.size("wanted") > 0)


def generate_journalled(chunks: DataFrame, generator_factory: Callable[[], object], path: str, keys: list[str],
                        text_col: str = "chunk", index_col: str = "real_index", n_questions: int = gn.DEFAULT_QUESTIONS_PER_CHUNK,
                        question_template: str = gn.QUESTION_TEMPLATE_API, answer_template: str = gn.ANSWER_TEMPLATE,
                        question_options: dict | None = None, answer_options: dict | None = None, keep: list[str] | None = None,
                        batch_size: int = gn.DEFAULT_PROMPT_BATCH, partitions: int | None = None,
                        questions_per_task: int = QUESTIONS_PER_TASK, with_run: bool = False) -> DataFrame:
    """The rows of ``generate_qa``, one for each chunk and question index, out of the journal at
    ``path`` after asking for what it lacks. ``keys`` (index_col among them) name a chunk.
    ``partitions`` asks for more tasks than ``questions_per_task`` makes; ``with_run`` adds the
    number of the run that answered. Chunks should be stored: they are read twice."""
    spark = chunks.sparkSession
    keep = list(keep or [])
    qo = dict(gn.QUESTION_OPTIONS if question_options is None else question_options)
    ao = dict(gn.ANSWER_OPTIONS if answer_options is None else answer_options)
    tagged = chunks.withColumn(ASKED, asked_key(text_col, question_template, answer_template, qo, ao)).withColumn(index_col, F.col(index_col).cast("long"))
    names = ["chunk_index" if k == index_col else k for k in keys]

    def answers(rows: DataFrame, wanted: str | None) -> DataFrame:
        return gn.generate_qa(rows, generator_factory, text_col=text_col, index_col=index_col, n_questions=n_questions, question_template=question_template,
                              answer_template=answer_template, question_options=qo, answer_options=ao, keep=[*keep, ASKED], batch_size=batch_size, wanted=wanted,
                              with_context=False)  # contexts stay with the chunks; the journal holds what the model said

    schema = answers(tagged, None).schema
    back = dict(zip(names, keys, strict=True))

    def successes():
        return read_journal(spark, path, schema).filter("error is null").select(*(F.col(n).alias(back[n]) for n in names), ASKED, "question_index")

    todo = open_questions(tagged, successes(), keys, n_questions)
    open_count = todo.agg(F.sum(F.size("wanted"))).first()[0] or 0
    if open_count:
        tasks = max(-(-open_count // questions_per_task), partitions or int(spark.conf.get(SPREAD, "0")) or 1)
        # dealt by key: a task that runs again asks the same
        dealt = todo.repartition(tasks, *keys, ASKED)
        number = max(_runs(spark, path), default=0) + 1
        (answers(dealt, "wanted").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .parquet(f"{path}/{RUN}={number}"))
    said = merged(read_journal(spark, path, schema).filter(F.col("question_index") < n_questions), names)
    mine = tagged.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(ASKED), F.col(text_col).alias("context"))
    found = mine.join(said.withColumnsRenamed({n: f"said_{n}" for n in [*names, ASKED]}),
                      [F.col(n).eqNullSafe(F.col(f"said_{n}")) for n in [*names, ASKED]])
    return found.select(*keep, "id", "question", "answer", "context", "question_index", "chunk_index", "error", *([RUN] if with_run else []))
