"""Files of a folder tree, listed and read by tasks.

Spark's own file scans list every file in the driver and plan them there: with millions of small files
that is gigabytes. Here a task lists a folder, level by level, into a stored table of files, as of the call;
content is read by tasks dealt by bytes, and only where a query uses it. The driver holds counts alone.

The files are those that Spark would list: names that begin with ``_`` (unless they hold a ``=``) or ``.`` are
left out, a glob holds for file names. ``list_files`` says None where only Spark's own listing will do: paths that
are no folder or hold a glob, file systems that pyarrow cannot open, globs of more than ``*``, ``?`` and ``[...]``,
sessions that skip missing or corrupt files or have no shared folder."""
from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_root, ensure_on_executors, scratch_path

#: Bytes of files that one task reads.
TASK_BYTES = 1 << 24
TASKS_PER_CORE = 4
LISTED_ROWS = 4096  # of a folder that leave together
CONTENT_BYTES = 1 << 22  # of files that leave together
FILES = "path string, modificationTime timestamp, length long"


def _entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, bytes, modification time in ms) of what lies in a folder. A local one is read as a stream."""
    if folder.startswith("file:"):
        with os.scandir("/" + folder[len("file:"):].lstrip("/")) as found:
            for entry in found:
                try:
                    at = entry.stat()
                    yield entry.name, entry.is_dir(), at.st_size, at.st_mtime_ns // 1_000_000
                except FileNotFoundError:  # gone meanwhile, or a link to nothing
                    continue
        return
    from pyarrow import fs as pafs
    filesystem, at = pafs.FileSystem.from_uri(folder)
    for info in filesystem.get_file_info(pafs.FileSelector(at)):
        yield info.base_name, info.type == pafs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1_000_000


def _hidden(name: str) -> bool:
    out = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return out and not name.startswith(("_common_metadata", "_metadata"))


def _lister(glob: str | None):
    """Batches of folders -> batches of (path, modificationTime, length); a folder has no length."""
    def run(batches):
        import pyarrow as pa

        match = re.compile(fnmatch.translate(glob)).match if glob else None
        rows = []

        def flush():
            paths, times, sizes = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([1000 * t for t in times], pa.timestamp("us", "UTC")), pa.array(sizes, pa.int64())],
                                              ["path", "modificationTime", "length"])

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                for name, is_folder, size, ms in _entries(folder):
                    if _hidden(name) or not (is_folder or match is None or match(name)):
                        continue
                    rows.append((f"{folder.rstrip('/')}/{name}", ms, None if is_folder else size))
                    if len(rows) >= LISTED_ROWS:
                        yield flush()
        if rows:
            yield flush()
    return run


def _folder(spark: SparkSession, path: str, glob: str | None) -> str | None:
    """The full URI of a folder that tasks can list; None if Spark's own listing has to."""
    if re.search(r"[*?\[{\\]", path) or re.search(r"[{}\\!^]", glob or ""):
        return None
    if any(spark.conf.get(f"spark.sql.files.{x}", "false").lower() == "true" for x in ("ignoreMissingFiles", "ignoreCorruptFiles")):
        return None
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(sc._jsc.hadoopConfiguration())
    if not (system.exists(place) and system.getFileStatus(place).isDirectory()):
        return None
    uri = system.makeQualified(place).toString()
    try:
        checkpoint_root(spark)
        if not uri.startswith("file:"):
            from pyarrow import fs as pafs
            pafs.FileSystem.from_uri(uri)
    except Exception:  # noqa: BLE001 - no shared folder, or a file system of Spark's alone
        return None
    return uri


def can_list(spark: SparkSession, path: str, glob: str | None = None) -> bool:
    return _folder(spark, path, glob) is not None


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame | None:
    """(path, modificationTime, length) of every file under the folder ``path``, stored, as of now; or None (see above)."""
    root = _folder(spark, path, glob)
    if root is None:
        return None
    ensure_on_executors(spark)
    stored, levels = scratch_path(spark, "files"), []
    folders = spark.range(0, 1, 1, 1).select(F.lit(root).alias("path"))
    while True:
        levels.append(f"{stored}/level-{len(levels)}")
        folders.mapInArrow(_lister(glob), FILES).write.parquet(levels[-1])
        inner = spark.read.schema(FILES).parquet(levels[-1]).filter("length is null").select("path")
        n = inner.count()
        if not n:
            return spark.read.schema(FILES).parquet(*levels).filter("length is not null")
        folders = inner.repartition(min(n, TASKS_PER_CORE * spark.sparkContext.defaultParallelism))


def read_files(files: DataFrame) -> DataFrame:
    """Listed files with their ``content``, in tasks of about ``TASK_BYTES``, at least some for each core. Files
    without a byte give no row, as in Spark's scans."""
    spark = files.sparkSession
    ensure_on_executors(spark)
    full = files.filter("length > 0")
    n, size = full.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(1, min(n, TASKS_PER_CORE * spark.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    # not deterministic: it is never copied into a filter, and left out where nothing uses it
    content = F.pandas_udf(_contents, "binary").asNondeterministic()
    return full.repartition(tasks).select("path", "modificationTime", "length", content("path").alias("content"))


def _contents(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The bytes of each file, in batches of about ``CONTENT_BYTES``."""
    from pyarrow import fs as pafs

    for batch in paths:
        out, held = [], 0
        for path in batch:
            if path.startswith("file:"):
                with open("/" + path[len("file:"):].lstrip("/"), "rb") as f:
                    out.append(f.read())
            else:
                filesystem, at = pafs.FileSystem.from_uri(path)
                with filesystem.open_input_file(at) as f:
                    out.append(f.read())
            held += len(out[-1])
            if held >= CONTENT_BYTES:
                yield pd.Series(out, dtype=object)
                out, held = [], 0
        if out:
            yield pd.Series(out, dtype=object)
