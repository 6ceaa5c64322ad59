"""Training-record projections of a QA frame, and per-record file bodies.

QA frame columns: id, question, answer, context, question_index, chunk_index
(+ anything else). Every format is a ``select``; nothing is collected."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DATAPOINT_FILE_FORMAT, QA_PAIR_FILE_FORMAT
from tessera.operators.rows import zip_index


def to_instruction_with_id(qa: DataFrame) -> DataFrame:
    return qa.select(F.col("question").alias("instruction"), F.lit("").alias("input"),
                     F.col("answer").alias("output"), "id")


def to_instruction(qa: DataFrame) -> DataFrame:
    return qa.select(F.col("question").alias("instruction"), F.lit("").alias("input"),
                     F.col("answer").alias("output"))


def to_alpaca(qa: DataFrame) -> DataFrame:
    """Alpaca records have the instruction shape; a separate sink writes them."""
    return to_instruction(qa)


def to_chat(qa: DataFrame, keep: list[str] | None = None) -> DataFrame:
    msgs = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content")),
                   F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return qa.select(*(keep or []), msgs.alias("messages"))


def json_string(c: Column) -> Column:
    """A string value as a JSON string literal (quoted, escaped), natively."""
    js = F.to_json(F.array(c.cast("string")))
    return F.substring(js, F.lit(2), F.length(js) - 2)


def pretty_json(fields: list[tuple[str, Column, bool]]) -> Column:
    """A flat object laid out like ``json.dump(obj, indent=2, ensure_ascii=False)``.
    Each field is (name, column, is_number)."""
    parts = []
    for i, (name, c, is_num) in enumerate(fields):
        sep = "," if i < len(fields) - 1 else ""
        parts += [F.lit(f'\n  "{name}": '), c.cast("string") if is_num else json_string(c), F.lit(sep)]
    return F.concat(F.lit("{"), *parts, F.lit("\n}"))


def qa_pair_json() -> Column:
    return pretty_json([("id", F.col("id"), False), ("question", F.col("question"), False),
                        ("answer", F.col("answer"), False), ("context", F.col("context"), False),
                        ("question_index", F.col("question_index"), True),
                        ("chunk_index", F.col("chunk_index"), True)])


def alpaca_json() -> Column:
    return pretty_json([("instruction", F.col("question"), False), ("input", F.lit(""), False),
                        ("output", F.col("answer"), False)])


def _ordered(qa: DataFrame, order_cols: list[str] | None, columns: list[str]) -> DataFrame:
    """QA rows with ``idx``, their position in QA order: by ``order_cols``, else by
    source path (where there is one), chunk and question, with the texts as the
    last resort, so the order is the same in every run."""
    order = order_cols or [*(["path"] if "path" in qa.columns else []), "chunk_index", "question_index"]
    ties = [c for c in ("id", "question", "answer") if c in qa.columns and c not in order]
    kept = [*dict.fromkeys([*order, *ties, *columns])]
    return zip_index(qa.select(*kept), "idx", [*order, *ties])


def alpaca_datapoint_files(qa: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """(file_name, body): one pretty JSON Alpaca record per QA pair, numbered in QA order."""
    idx = _ordered(qa, order_cols, ["question", "answer"])
    return idx.select(F.format_string(DATAPOINT_FILE_FORMAT, "idx").alias("file_name"),
                      alpaca_json().alias("body"))


def qa_pair_files(qa: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """(file_name, body): one pretty JSON QA pair per file, numbered in QA order."""
    idx = _ordered(qa, order_cols, ["id", "question", "answer", "context", "question_index", "chunk_index"])
    return idx.select(F.format_string(QA_PAIR_FILE_FORMAT, "idx").alias("file_name"),
                      qa_pair_json().alias("body"))


def _prefixed(name: Column, prefix_col: str | None, root: str | None = None) -> Column:
    """Optionally put the name under a folder named after the source file: its
    path below the input folder ``root``, so that files of the same name in
    different folders stay apart; without ``root`` the whole path, scheme and all
    leading slashes left out."""
    if not prefix_col:
        return name
    path = F.regexp_replace(F.col(prefix_col), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    path = F.regexp_replace(path, "^/+", "")
    if root:
        base = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).strip("/") + "/"
        path = F.when(path.startswith(base) & (path != base), F.substr(path, F.lit(len(base) + 1))).otherwise(
            F.when(path == base.rstrip("/"), F.element_at(F.split(path, "/"), -1)).otherwise(path))
    return F.concat(path, F.lit("/"), name)


def chunk_files(chunks: DataFrame, name_format: str, key: str = "chunk_index",
                text_col: str = "chunk", prefix_col: str | None = None, root: str | None = None) -> DataFrame:
    """(file_name, body): one text file per chunk, named from its key."""
    return chunks.select(_prefixed(F.format_string(name_format, F.col(key)), prefix_col, root).alias("file_name"),
                         F.col(text_col).alias("body"))


def chunk_qa_files(qa: DataFrame, name_format: str, key: str = "chunk_index",
                   prefix_col: str | None = None, root: str | None = None) -> DataFrame:
    """(file_name, body): one pretty JSON file per QA pair, named from the chunk
    key and the question index (the incremental layout)."""
    name = F.format_string(name_format, F.col(key), F.col("question_index"))
    return qa.select(_prefixed(name, prefix_col, root).alias("file_name"), qa_pair_json().alias("body"))
