"""Many inputs into one table, with what cannot be read put aside.

Each input is read by Spark and stored; only a stored input counts as read, so an error
that shows while rows are read (a broken page, a worker's exception) is found here and not in a
later job, and a failed write leaves nothing behind. An input of several files that fails is halved
until the files that fail stand alone, so a broken file costs a number of jobs that grows with the
logarithm of the files, and its neighbours stay. Malformed records (a JSON line that is no
object, a CSV row that does not fit the types) do not fail their file: they are put aside with their text.

Schemas are merged by name: a missing column is null; integers widen to long, long and
fractions to double, dates to timestamps; structs merge by field and arrays by element; kinds
that have nothing else in common become strings (nested ones as JSON).

Defined cases: an input without a required column is an error; an input without files or
without rows gives neither rows nor errors unless Spark refuses it; no readable input gives an empty table of the
required columns; columns whose names differ in case only are one column of the first spelling."""
from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.readers import detect_format

ERRORS = "path string, kind string, record string, error string"
CORRUPT = "_corrupt_record"
PATH = "source_path"

_WIDTH = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both; string where nothing else does."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if type(a) in _WIDTH and type(b) in _WIDTH:
        high, low = sorted((_WIDTH.index(type(x)) for x in (a, b)), reverse=True)
        # a float does not hold every int
        return T.DoubleType() if high == 4 and low > 1 else _WIDTH[high]()
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, dates) and isinstance(b, dates):
        return T.TimestampType() if T.TimestampType() in (a, b) or T.DateType() not in (a, b) else T.TimestampNTZType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(min(38, whole + scale), scale) if whole + scale <= 38 else T.DoubleType()
    if {type(a), type(b)} & {T.DecimalType} and {type(a), type(b)} & set(_WIDTH):
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged_schema([a, b])
    return T.StringType()


def merged_schema(schemas: Iterable[T.StructType]) -> T.StructType:
    """All fields of all schemas, in the order of their first coming, each as the least type that holds it."""
    found: dict[str, T.StructField] = {}
    for s in schemas:
        for f in s.fields:
            old = found.get(f.name.lower())
            found[f.name.lower()] = T.StructField(old.name, wider(old.dataType, f.dataType)) if old else T.StructField(f.name, f.dataType)
    return T.StructType(list(found.values()))


def _as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        mine = {f.name.lower(): f for f in have.fields}
        parts = [(_as_type(c[mine[f.name.lower()].name], mine[f.name.lower()].dataType, f.dataType) if f.name.lower() in mine
                  else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: _as_type(x, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    return c.cast(want)


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df in a merged schema: columns by name, missing ones null."""
    mine = {f.name.lower(): f for f in df.schema.fields}
    return df.select(*((_as_type(F.col(f"`{mine[f.name.lower()].name}`"), mine[f.name.lower()].dataType, f.dataType) if f.name.lower() in mine
                        else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))


def read_lenient(spark: SparkSession, files: list[str], fmt: str) -> DataFrame:
    """Files of one format with PATH and, where the format has records that can be malformed, CORRUPT."""
    r = spark.read
    if fmt == "parquet":
        df = r.option("mergeSchema", True).parquet(*files)
    elif fmt == "json":
        df = r.option("columnNameOfCorruptRecord", CORRUPT).json(files)
    else:
        # a file whose header differs from the first one's is refused, not misread
        options = dict(header=True, multiLine=True, escape='"', quote='"', enforceSchema=False)
        known = r.csv(files, inferSchema=True, **options).schema
        df = r.csv(files, schema=T.StructType([*known.fields, T.StructField(CORRUPT, T.StringType())]), columnNameOfCorruptRecord=CORRUPT, **options)
    return df.withColumn(PATH, F.col("_metadata.file_path"))


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files under a path or pattern; their names alone go to the driver."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return sorted(r["path"] for r in listed.select("path").collect())


def read_quarantined(spark: SparkSession, inputs: Iterable[str], out: str, require: Iterable[str] = (), file_type: str = "auto",
                     reader: Callable[[SparkSession, list[str], str], DataFrame] = read_lenient) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of all inputs (paths or patterns of CSV, JSON lines or Parquet). Rows have the
    merged columns and PATH; errors have path, kind ('input', 'record'), record (its text) and error. What
    was read is stored under ``out``, a folder on storage that all executors see."""
    require, stored, bad = list(require), [], []

    def load(files: list[str], fmt: str, as_given: str) -> None:
        place = f"{out.rstrip('/')}/part-{len(stored) + len(bad):05d}"
        try:
            df = reader(spark, files, fmt)
            lacks = [c for c in require if c.lower() not in (x.lower() for x in df.columns)]
            if lacks:
                raise ValueError(f"no column {', '.join(map(repr, lacks))}; it has {', '.join(c for c in df.columns if c not in (PATH, CORRUPT))}")
            df.write.mode("overwrite").parquet(place)
            stored.append(spark.read.parquet(place))
        except Exception as e:  # noqa: BLE001 - whatever stops an input is recorded with it
            if len(files) == 1:
                bad.append((as_given if files[0] == as_given else files[0], "input", None, f"{type(e).__name__}: {e}"[:2000]))
                return
            half = len(files) // 2
            load(files[:half], fmt, files[0])
            load(files[half:], fmt, files[half])

    for path in inputs:
        try:
            files = files_of(spark, path)
        except Exception as e:  # noqa: BLE001
            bad.append((path, "input", None, f"{type(e).__name__}: {e}"[:2000]))
            continue
        by_format: dict[str, list[str]] = {}
        for f in files:
            by_format.setdefault(detect_format(f, file_type), []).append(f)
        for fmt, group in by_format.items():
            load(group, fmt, group[0])

    def clean(df):
        return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT) if CORRUPT in df.columns else df

    frames = [clean(df) for df in stored]
    errors = spark.createDataFrame(bad, ERRORS)
    for df in stored:
        if CORRUPT in df.columns:
            errors = errors.unionByName(df.filter(F.col(CORRUPT).isNotNull()).select(
                F.col(PATH).alias("path"), F.lit("record").alias("kind"), F.col(CORRUPT).alias("record"), F.lit("malformed record").alias("error")))
    empty = T.StructType([*(T.StructField(c, T.StringType()) for c in require), T.StructField(PATH, T.StringType())])
    schema = merged_schema([df.schema for df in frames]) if frames else empty
    rows = reduce(DataFrame.unionAll, [conformed(df, schema) for df in frames]) if frames else spark.createDataFrame([], empty)
    return rows.select(*(c for c in rows.columns if c != PATH), PATH), errors
