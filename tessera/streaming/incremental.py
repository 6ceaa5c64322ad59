"""Incremental processing: resume by key, progress metrics, and a Structured
Streaming job that chunks new text files and saves chunks/QA per micro-batch.

The stream reuses the batch column functions unchanged; each micro-batch takes only
files that no earlier one has taken, which replaces the reference's per-chunk save
callback and its manual start-index resume. Which files a batch takes stands in a table
beside the checkpoint: tasks list the folder and join it with that table, so the driver
holds no file names (Spark's file source holds all that it ever saw, and lists those of a
batch one by one)."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.chunk import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE, chunk_text
from tessera.operators.journal import exists
from tessera.sources.listing import FILES, can_list, list_files, read_files
from tessera.sources.readers import TASKS_PER_CORE, text_files_frame


MIN_TASKS = 64  # of a micro-batch with as many files
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def resume_anti(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys are not in ``done`` (already written). A
    left-anti join: shuffled on the keys, or broadcast by AQE when small."""
    return new.join(done.select(*keys), keys, "left_anti")


def with_progress(df: DataFrame, name: str = "progress", text_col: str | None = None) -> tuple[DataFrame, Observation]:
    """Attach running totals (rows, characters) computed as the frame is consumed."""
    obs = Observation(name)
    exprs = [F.count(F.lit(1)).alias("rows")]
    if text_col:
        exprs.append(F.sum(F.length(text_col)).alias("chars"))
    return df.observe(obs, *exprs), obs


def stream_text_files(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                      size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                      per_batch: Callable[[DataFrame, int], None] | None = None,
                      glob: str = "*.[tT][xX][tT]", available_now: bool = True):
    """Chunk every new text file under ``in_dir`` into Parquet at ``out_dir``.

    ``per_batch(chunks, batch_id)`` may add more sinks (QA generation, files);
    it must be idempotent per batch id, since a batch is replayed after a
    failure. Returns the started query."""
    state, root = checkpoint.rstrip("/"), out_dir.rstrip("/")

    def sink(docs: DataFrame, batch_id: int) -> None:
        # overwrite this batch's own folder: replaying the batch is harmless
        out = f"{root}/batch_id={batch_id}"
        chunk_text(docs, text_col="text", size=size, overlap=overlap, keep=["path"]).write.mode("overwrite").parquet(out)
        if per_batch is not None:
            per_batch(spark.read.parquet(out), batch_id)

    # a state that Spark's file source began goes on with it
    if can_list(spark, in_dir, glob) and not exists(spark, f"{state}/sources"):
        w = _new_files_stream(spark, in_dir, glob, f"{state}/files", sink).option("checkpointLocation", f"{state}/batches")
    else:
        files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", glob)
                 .option("recursiveFileLookup", "true").load(in_dir))
        # a batch of many small files is few tasks, as in read_binary_files
        docs = text_files_frame(files.coalesce(max(MIN_TASKS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)))
        w = docs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _new_files_stream(spark: SparkSession, in_dir: str, glob: str, taken: str, sink: Callable[[DataFrame, int], None]):
    """A stream whose batches give ``sink`` the documents of files that none before has taken; a batch without any does
    nothing. Spark's clock source counts the batches; what a batch takes is stored first, so a replay takes the same."""
    def batch(_: DataFrame, batch_id: int) -> None:
        mine = f"{taken}/batch_id={batch_id}"
        if not exists(spark, f"{mine}/_SUCCESS"):
            new = list_files(spark, in_dir, glob)
            if new is None:
                raise FileNotFoundError(f"no folder to list at {in_dir}")
            if exists(spark, taken):
                before = spark.read.schema(f"{FILES}, batch_id long").parquet(taken).filter(F.col("batch_id") < batch_id)
                new = resume_anti(new, before, ["path"])
            if new.isEmpty():
                return
            new.write.mode("overwrite").parquet(mine)
        sink(text_files_frame(read_files(spark.read.schema(FILES).parquet(mine))), batch_id)

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return ticks.writeStream.foreachBatch(batch)


def running_qa_stats(qa_stream: DataFrame, type_col: str = "question_type") -> DataFrame:
    """Streaming A1/A2: counts per question type and mean lengths, updated per
    micro-batch (run with outputMode 'complete')."""
    t = F.coalesce(F.col(type_col), F.lit("unknown")) if type_col in qa_stream.columns else F.lit("unknown")
    return qa_stream.groupBy(t.alias("question_type")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("question")).alias("avg_question_length"),
        F.avg(F.length("answer")).alias("avg_answer_length"))


def stream_documents_to_qa(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                           generator_factory: Callable, n_questions: int = 3,
                           size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                           save_individual: bool = False, glob: str = "*.[tT][xX][tT]", available_now: bool = True):
    """The reference's save-as-you-go run as a stream: every new text file is
    chunked, its chunks get QA pairs from the plug-in, and each micro-batch
    writes its chunks, its QA rows and (optionally) one file per chunk and per
    QA pair. A replayed batch overwrites exactly its own outputs."""
    from tessera.functions.text import CHUNK_FILE_FORMAT, CHUNK_QA_FILE_FORMAT
    from tessera.operators.formats import chunk_files, chunk_qa_files
    from tessera.operators.generate import generate_qa
    from tessera.sources.sinks import qualified, write_files

    source = qualified(spark, in_dir)
    root = out_dir.rstrip("/")

    def per_batch(chunks: DataFrame, batch_id: int) -> None:
        stored = spark.read.parquet(f"{root}/chunks/batch_id={batch_id}")
        qa = generate_qa(stored, generator_factory, index_col="chunk_index", n_questions=n_questions,
                         keep=["path"])
        qa.write.mode("overwrite").parquet(f"{root}/qa/batch_id={batch_id}")
        if save_individual:
            qa_stored = spark.read.parquet(f"{root}/qa/batch_id={batch_id}")
            write_files(chunk_files(stored, CHUNK_FILE_FORMAT, prefix_col="path", root=source), f"{root}/files")
            write_files(chunk_qa_files(qa_stored, CHUNK_QA_FILE_FORMAT, prefix_col="path", root=source), f"{root}/files")

    return stream_text_files(spark, in_dir, f"{root}/chunks", checkpoint, size, overlap, per_batch, glob,
                             available_now)
