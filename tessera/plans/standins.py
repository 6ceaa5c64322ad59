"""Adapters that derive the reference's record shapes from the driver tables.

The reference works on PDF pages and model-generated QA pairs; the test tables
have neither, so Spark derives them from tables that do exist (work grows with
the tables):
* pages: each document cut into fixed-width pages, and a blank page put in after
  every six, so blank-page handling is exercised and no text is lost;
* QA pairs: a ``user`` turn directly followed by an ``assistant`` turn of the
  same conversation. The pairing is an equi-join on (conv_id, turn) -- keys
  are nearly unique, so even one giant conversation spreads over all tasks
  (a window partitioned by conversation would put it in one task)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import qa_id

PAGE_CHARS = 2000
BLANK_EVERY = 7
BLANK_PAGE = "  \n\t "


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pages_from_documents(docs: DataFrame, page_chars: int = PAGE_CHARS,
                         blank_every: int = BLANK_EVERY) -> DataFrame:
    """(doc_id, source, page_num, text): the whole text as pages of ``page_chars``
    characters, with a blank page more after every ``blank_every - 1`` of them."""
    n_text = F.greatest(F.ceil(F.length("text") / F.lit(page_chars)), F.lit(1)).cast("int")
    n_pages = n_text + F.floor(n_text / F.lit(blank_every - 1)).cast("int")
    exploded = docs.filter(F.col("text").isNotNull()).select(
        "doc_id", "source", "text", F.explode(F.sequence(F.lit(1), n_pages)).alias("page_num"))
    nth = F.col("page_num") - F.floor(F.col("page_num") / F.lit(blank_every)).cast("int")
    body = F.substring("text", (nth - 1) * page_chars + 1, page_chars)
    return exploded.select("doc_id", "source", "page_num",
                           F.when(F.col("page_num") % blank_every == 0, F.lit(BLANK_PAGE))
                           .otherwise(body).alias("text"))


def qa_pairs_from_conversations(conv: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """QA-pair frame: id, question, answer, context, question_index, chunk_index
    (+ question_type when ``labels`` is given: the label's quality as text)."""
    u = conv.filter(F.col("role") == "user").select(
        F.col("conv_id"), F.col("turn"), F.col("text").alias("question"))
    a = conv.filter(F.col("role") == "assistant").select(
        F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = u.join(a, ["conv_id", "turn"])
    out = qa.select(qa_id("conv_id", "turn").alias("id"), "question", "answer",
                    F.col("question").alias("context"),
                    F.col("turn").cast("int").alias("question_index"),
                    F.col("conv_id").alias("chunk_index"))
    if labels is not None:
        lab = labels.select(F.col("doc_id").alias("chunk_index"),
                            F.col("quality").cast("string").alias("question_type"))
        out = out.join(lab, "chunk_index", "left")
    return out
