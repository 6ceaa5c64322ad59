"""Sinks: JSON lines, CSV, Parquet vectors, one file per record, and the
multi-format export of a QA frame.

The QA frame is written once (Parquet) before any export, because the model
calls behind it are expensive and non-deterministic: every format is then a
plain projection of the stored table."""
from __future__ import annotations

import datetime as _dt
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import formats as fm
from tessera.operators.stats import metadata
from tessera.session import ensure_on_executors

FOLDERS_KEPT = 1024  # folders that a writer knows it has made


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """JSON lines, UTF-8, nulls written as null (not dropped)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path


def _csv_ready(df: DataFrame) -> DataFrame:
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        simple = isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType, T.DateType,
                                         T.TimestampType))
        cols.append(F.col(f.name) if simple else F.to_json(f.name).alias(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str | None:
    """CSV with a header and the columns in sorted order; nested values as JSON.
    An empty frame writes nothing (returns None), as in the reference."""
    if df.isEmpty():
        return None
    (_csv_ready(df).write.mode(mode)
     .csv(path, header=True, escape='"', quote='"', nullValue="", emptyValue='""',
          ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return path


def write_embeddings(df: DataFrame, path: str, keys: list[str], vec_col: str = "embedding",
                     mode: str = "overwrite") -> str:
    """Vectors with their keys (Parquet), instead of a key-less matrix file."""
    df.select(*keys, vec_col).write.mode(mode).parquet(path)
    return path


def _file_writer(base: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs as pafs
        if base.startswith("file:"):
            filesystem, root = pafs.LocalFileSystem(), "/" + base[len("file:"):].lstrip("/")
        elif "://" in base:
            filesystem, root = pafs.FileSystem.from_uri(base)
        else:
            filesystem, root = pafs.LocalFileSystem(), base
        filesystem.create_dir(root, recursive=True)
        made = {root.rstrip("/")}  # folders made of late
        for pdf in batches:
            sizes = []
            for name, body in zip(pdf["file_name"], pdf["body"]):
                data = (body or "").encode("utf-8")
                target = f"{root.rstrip('/')}/{name}"
                if (folder := target.rsplit("/", 1)[0]) not in made:
                    filesystem.create_dir(folder, recursive=True)
                    if len(made) >= FOLDERS_KEPT:
                        made.clear()
                    made.add(folder)
                # same name, same bytes: a retried task rewrites identical files
                with filesystem.open_output_stream(target) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"file_name": pdf["file_name"], "bytes": sizes})
    return run


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a full URI on the cluster's default filesystem, the one that
    Spark's own writers use for a path without a scheme."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(place).toString()


def write_files(files: DataFrame, base: str) -> int:
    """Write each (file_name, body) row as its own UTF-8 file under ``base``
    (any filesystem pyarrow can open; a path without a scheme is on the cluster's
    default one). Runs in the executors; returns the count. File names must be
    unique: later rows would overwrite earlier ones."""
    spark = files.sparkSession
    ensure_on_executors(spark)
    out = files.select("file_name", "body").mapInPandas(_file_writer(qualified(spark, base)), "file_name string, bytes long")
    return int(out.agg(F.count(F.lit(1))).first()[0])


def timestamped_base(prefix: str = "dataset") -> str:
    return f"{prefix}_{_dt.datetime.now().strftime('%Y%m%d_%H%M%S')}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: cuts lineage and makes later reads free of
    recomputation (model calls) and safe against lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def export_qa(qa: DataFrame, out_dir: str, base: str | None = None, output_format: str = "all",
              embeddings: DataFrame | None = None, embedding_keys: list[str] | None = None,
              source_file: str | None = None, datapoint_files: bool = False,
              stored: bool = False) -> dict[str, str]:
    """Write the QA frame in the requested formats: 'json', 'csv' or 'all'
    (raw json + csv, instructions with and without id, alpaca, alpaca data
    points if ``datapoint_files``, chat), plus vectors and metadata when given. ``stored=True`` means
    ``qa`` already reads a written table, so it is not written again."""
    if output_format not in ("json", "csv", "all"):
        raise ValueError("output_format must be json, csv or all")
    base = base or timestamped_base()
    root = out_dir.rstrip("/")
    out: dict[str, str] = {}
    if not stored:
        qa = materialize(qa, f"{root}/{base}_qa.parquet")
        out["qa_parquet"] = f"{root}/{base}_qa.parquet"
    instr_id = fm.to_instruction_with_id(qa)
    if output_format in ("json", "all"):
        out["instructions_json"] = write_json(instr_id, f"{root}/{base}_instructions_id.json")
    if output_format in ("csv", "all"):
        p = write_csv(instr_id, f"{root}/{base}_instructions_id.csv")
        if p:
            out["instructions_csv"] = p
    if output_format == "all":
        out["json"] = write_json(qa, f"{root}/{base}.json")
        p = write_csv(qa, f"{root}/{base}.csv")
        if p:
            out["csv"] = p
        out["instructions"] = write_json(fm.to_instruction(qa), f"{root}/{base}_instructions.json")
        out["alpaca"] = write_json(fm.to_alpaca(qa), f"{root}/{base}_alpaca.json")
        out["chat"] = write_json(fm.to_chat(qa), f"{root}/{base}_chat.json")
        if datapoint_files:
            write_files(fm.alpaca_datapoint_files(qa), f"{root}/{base}_alpaca")
            out["alpaca_datapoints"] = f"{root}/{base}_alpaca"
    if embeddings is not None:
        out["embeddings"] = write_embeddings(embeddings, f"{root}/{base}_embeddings.parquet",
                                             embedding_keys or [])
    if source_file is not None:
        out["metadata"] = write_json(metadata(qa, source_file).coalesce(1), f"{root}/{base}_metadata.json")
    return out
