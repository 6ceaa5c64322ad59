"""Readers for the reference's inputs, all plain Spark scans.

* tables of text: CSV / JSON / JSONL / Parquet (format from the extension,
  unknown extensions read as CSV);
* named datasets: a catalog table or a path, one split chosen by an equality
  filter on the split column, so partition pruning applies;
* text files: listed and read by tasks, native decode cascade, text cleaning;
* PDF pages: a plug-in extractor run by ``mapInPandas`` (no codec built in).
"""
from __future__ import annotations

from typing import Callable, Iterable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.decode import decode_text
from tessera.functions.text import clean_txt, preview
from tessera.operators.rows import with_row_index
from tessera.session import ensure_on_executors
from tessera.sources.listing import TASK_BYTES, TASKS_PER_CORE, list_files, read_files

PAGES_CHARS = 1 << 20  # of pages that leave together
#: Suffix (or explicit type) -> Spark reader.
READERS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet"}


def detect_format(path: str, file_type: str = "auto") -> str:
    """Reader for a path: by its suffix, CSV where the suffix says nothing; an
    explicit ``file_type`` must be one we read."""
    if file_type == "auto":
        return READERS.get(path.rstrip("/").rpartition(".")[2].lower(), "csv")
    try:
        return READERS[file_type]
    except KeyError:
        raise ValueError(f"cannot read tables of type {file_type!r}; known types: {', '.join(READERS)}") from None


def read_table(spark: SparkSession, path: str, file_type: str = "auto",
               schema: T.StructType | str | None = None, json_array: bool = False,
               sampling_ratio: float | None = None, multi_line: bool = True) -> DataFrame:
    """Read a table of text. CSV: header, quoted fields; JSON: one object a line, or
    (``json_array=True``) one top-level array a file. Types are inferred from all rows
    without ``schema``; on large inputs pass one, or a ``sampling_ratio``. CSV
    fields may hold line ends, so each CSV file is one task; where they do not,
    ``multi_line=False`` lets Spark split the files."""
    fmt = detect_format(path, file_type)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    elif sampling_ratio is not None:
        r = r.option("samplingRatio", sampling_ratio)
    if fmt == "csv":
        return r.csv(path, header=True, inferSchema=schema is None, multiLine=multi_line,
                      escape='"', quote='"')
    if fmt == "json":
        return r.json(path, multiLine=json_array)
    return r.parquet(path)


def read_named(spark: SparkSession, name: str, split: str | None = "train",
               config: str | None = None, split_col: str = "split") -> DataFrame:
    """A named dataset: catalog table ``[config.]name`` (or a Parquet path),
    restricted to one split when the table has a split column."""
    if "/" in name:
        df = spark.read.parquet(name)
    else:
        df = spark.table(f"{config}.{name}" if config else name)
    if split is not None and split_col in df.columns:
        df = df.filter(F.col(split_col) == split)
    return df


def read_binary_files(spark: SparkSession, path: str, glob: str | None = None,
                      recursive: bool = True) -> DataFrame:
    """One row per file: (path, modificationTime, length, content), as of now. A folder is listed and read by
    tasks (``sources.listing``), what they cannot list by Spark's own scan."""
    if recursive and (listed := list_files(spark, path, glob)) is not None:
        return read_files(listed)
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return _in_few_tasks(r.load(path))


def _in_few_tasks(files: DataFrame) -> DataFrame:
    """The same rows in tasks of about ``TASK_BYTES``, at least some for each core. Spark counts 4 MB for opening a file, so
    a scan of small files has a task for every few of them, and scheduling those takes longer than reading."""
    size = int(str(files._jdf.queryExecution().analyzed().stats().sizeInBytes()))
    return files.coalesce(max(TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def read_text_files(spark: SparkSession, path: str, glob: str | None = "*.[tT][xX][tT]",
                    banner: bool = True) -> DataFrame:
    """One row per text file: (path, text), decoded with the encoding cascade
    and cleaned like the reference's text reader (banner kept by default).
    Zero-byte files produce no row (Spark's file scan skips them)."""
    files = read_binary_files(spark, path, glob)
    return files.select("path", clean_txt(decode_text("content"), banner=banner).alias("text"))


def text_files_frame(files: DataFrame, banner: bool = True) -> DataFrame:
    """Same as ``read_text_files`` over an existing binaryFile frame (batch or stream)."""
    return files.select("path", clean_txt(decode_text("content"), banner=banner).alias("text"))


PageExtractor = Callable[[bytes], Iterable[str]]


def read_pdf_pages(spark: SparkSession, path: str, extractor_factory: Callable[[], PageExtractor],
                   max_pages: int | None = None, glob: str = "*.[pP][dD][fF]", with_errors: bool = False) -> DataFrame:
    """One row per page: (path, page_num, text). The extractor is built once per
    task by ``extractor_factory`` and maps file bytes to page texts in order.
    Pages past ``max_pages`` are not extracted. A file whose extraction fails
    ends the job, unless ``with_errors``: then a column ``error`` is added, and
    the file's last row has a null page and the error instead."""
    ensure_on_executors(spark)
    files = read_binary_files(spark, path, glob).select("path", "content")
    schema = "path string, page_num int, text string" + ", error string" * with_errors
    names = ["path", "page_num", "text"] + ["error"] * with_errors

    def frame(rows):
        return pd.DataFrame([r[:len(names)] for r in rows], columns=names).astype({"page_num": "Int32"})

    def run(batches):
        extract = extractor_factory()
        for pdf in batches:
            rows, held = [], 0
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for i, text in enumerate(extract(bytes(content)), start=1):
                        if max_pages and i > max_pages:
                            break
                        rows.append((p, i, text or "", None))
                        held += len(rows[-1][2])
                        if len(rows) >= 256 or held >= PAGES_CHARS:  # a long file leaves in parts
                            yield frame(rows)
                            rows, held = [], 0
                except Exception as e:  # noqa: BLE001 - reported with its file
                    if not with_errors:
                        raise
                    rows.append((p, None, None, repr(e)))
            if rows:
                yield frame(rows)

    return files.mapInPandas(run, schema)


DOCUMENT_EXTENSIONS = ("pdf", "txt")


def check_document_path(spark: SparkSession, path: str) -> None:
    """Checks for one input: missing -> FileNotFoundError; a single file that is
    neither PDF nor text -> ValueError. Folders are routed by
    ``split_by_extension`` instead."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise FileNotFoundError(f"nothing to read at {path}")
    if fs.getFileStatus(hpath).isFile():
        ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
        if ext not in DOCUMENT_EXTENSIONS:
            raise ValueError(f"documents are {' or '.join(DOCUMENT_EXTENSIONS)} files, not {ext or 'without a suffix'}: {path}")


def split_by_extension(files: DataFrame) -> dict[str, DataFrame]:
    """Route a binaryFile frame by lower-cased extension: 'pdf', 'txt' and
    'unsupported' (kept aside for the caller to report)."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    tagged = files.withColumn("__ext", ext)
    return {
        "pdf": tagged.filter(F.col("__ext") == "pdf").drop("__ext"),
        "txt": tagged.filter(F.col("__ext") == "txt").drop("__ext"),
        "unsupported": tagged.filter(~F.col("__ext").isin("pdf", "txt")).drop("__ext"),
    }


def dataset_info(df: DataFrame, name: str, split: str | None = "train", config: str | None = None,
                 text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """One row describing a dataset: counts, columns, feature types, whether the
    text column exists and a preview of the first row (each value stringified,
    cut to 100 characters + '...'). The first row is the smallest ``order_col``,
    else the first row in file order."""
    if order_col:
        first = df.orderBy(order_col).limit(1)
    else:
        try:  # Parquet: the first row in file order (a top-1, not a full sort)
            first = (df.select("*", F.col("_metadata.file_path").alias("__f"),
                               F.col("_metadata.row_index").alias("__r"))
                     .orderBy("__f", "__r").limit(1).drop("__f", "__r"))
        except AnalysisException:  # no row numbers: the row at position 0
            first = with_row_index(df, "__r").orderBy("__r").limit(1).drop("__r")
    sample = F.create_map(*[x for c in df.columns for x in (F.lit(c), preview(F.col(c)))])
    stats = df.agg(F.count(F.lit(1)).alias("total_samples"))
    feats = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    info = stats.select(
        F.lit(name).alias("name"), F.lit(split).cast("string").alias("split"),
        F.lit(config).cast("string").alias("config"), "total_samples",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"), feats.alias("features"),
        F.lit(text_col in df.columns).alias("text_column_exists"))
    samp = first.select(sample.alias("sample_data"))
    # one row each side: a plain join on a constant key, no cross product
    return info.withColumn("__k", F.lit(1)).join(samp.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
