"""Statistics over QA, chunk and run frames: single-pass aggregations with
map-side partial aggregation (skew-safe: a hot group is pre-combined per task)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_TYPE = "unknown"


def _len(c: str):
    return F.length(F.coalesce(F.col(c), F.lit("")))


def qa_stats(qa: DataFrame) -> DataFrame:
    """Count and mean lengths of question, answer and context (absent -> '').
    Empty input gives one row with count 0 and null means."""
    return qa.agg(F.count(F.lit(1)).alias("total_pairs"),
                  F.avg(_len("question")).alias("avg_question_length"),
                  F.avg(_len("answer")).alias("avg_answer_length"),
                  F.avg(_len("context")).alias("avg_context_length"))


def question_type_counts(qa: DataFrame, type_col: str = "question_type") -> DataFrame:
    t = F.coalesce(F.col(type_col), F.lit(UNKNOWN_TYPE)) if type_col in qa.columns else F.lit(UNKNOWN_TYPE)
    return qa.groupBy(t.alias("question_type")).agg(F.count(F.lit(1)).alias("n"))


def metadata(qa: DataFrame, source_file: str, description: str = "Instruction dataset generated from PDF document",
             type_col: str = "question_type") -> DataFrame:
    """One row: dataset_info struct + statistics struct (question_types map,
    mean question and answer length). Computed from one grouped pass: per
    type counts and length sums, then a tiny final aggregation."""
    t = F.coalesce(F.col(type_col), F.lit(UNKNOWN_TYPE)) if type_col in qa.columns else F.lit(UNKNOWN_TYPE)
    per_type = qa.groupBy(t.alias("t")).agg(F.count(F.lit(1)).alias("n"),
                                            F.sum(_len("question")).alias("q"),
                                            F.sum(_len("answer")).alias("a"))
    stem = source_file.rstrip("/").split("/")[-1].rsplit(".", 1)[0]
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return per_type.agg(
        F.struct(F.lit(f"Generated from {stem}").alias("name"), F.lit(description).alias("description"),
                 F.lit(source_file).alias("source_file"), total.alias("total_qa_pairs"),
                 F.current_timestamp().cast("string").alias("generation_timestamp")).alias("dataset_info"),
        F.struct(F.map_from_entries(F.collect_list(F.struct("t", "n"))).alias("question_types"),
                 (F.sum("q") / F.sum("n")).alias("avg_question_length"),
                 (F.sum("a") / F.sum("n")).alias("avg_answer_length")).alias("statistics"))


def chunk_stats(chunks: DataFrame, by: list[str] | None = None, text_col: str = "chunk") -> DataFrame:
    n = F.length(text_col)
    return chunks.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(n).alias("avg_chunk_chars"),
        F.min(n).alias("min_chunk_chars"), F.max(n).alias("max_chunk_chars"))


def dataset_chunk_stats(chunks: DataFrame, text_col: str = "chunk") -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.length(text_col)).alias("avg_chunk_chars"))


def run_summary(chunks: DataFrame, qa: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks, QA pairs, embeddings and QA per chunk in one row. The three
    counts are unioned as tagged rows and folded by one aggregation (no
    cross join); QA per chunk is null when there are no chunks."""
    tagged = (chunks.select(F.lit("c").alias("k")).unionByName(qa.select(F.lit("q").alias("k")))
              .unionByName(embeddings.select(F.lit("e").alias("k"))))
    agg = tagged.agg(F.count_if(F.col("k") == "c").alias("text_chunks"),
                     F.count_if(F.col("k") == "q").alias("qa_pairs"),
                     F.count_if(F.col("k") == "e").alias("embeddings"))
    return agg.withColumn("qa_per_chunk", F.try_divide(F.col("qa_pairs"), F.col("text_chunks")))
