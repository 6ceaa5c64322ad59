"""CSV files with line ends inside quoted fields, read by as many tasks as a file has splits.

A line begins inside a quoted field where the number of quotes before it is odd (a doubled
quote inside a field counts twice and changes nothing). One native pass counts quotes per split, and a
prefix sum per file gives the state in which each split begins; one scan through Python then joins lines to
the records that lie in one split. The pieces of records
that cross a split, at most two a split, are the lines before a split's first or from its last
turn of the state on: they are picked natively and alone are shuffled."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_on_executors

QUOTE = '"'
LINE = "line"  # column: a line's number in the scan, all that crosses to Python besides its text
PARTITION_BITS = 33  # of monotonically_increasing_id, below a partition's number
RECORDS = "start long, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def split_states(lines: DataFrame) -> DataFrame:
    """One row a split that has lines, as many as the scan's own plan lists on the driver: ``start``, its first
    line, whether it begins ``inside`` a quoted field, and ``first`` and ``last``, its lines with an odd
    number of quotes. ``head`` and ``tail`` are numbers, per file, of the records whose piece it begins and ends with."""
    value = F.col("value")
    quotes = F.when(F.contains(value, F.lit(QUOTE)), F.octet_length(value) - F.octet_length(F.replace(value, F.lit(QUOTE), F.lit("")))).otherwise(0)
    line = lines.select("file", "block", quotes.alias("quotes"), F.monotonically_increasing_id().alias(LINE))
    turn = F.when(F.col("quotes") % 2 == 1, F.col(LINE))
    turns = line.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"), F.min(LINE).alias("start"), F.min(turn).alias("first"), F.max(turn).alias("last"))
    by_block = Window.partitionBy("file").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    state = turns.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    ends = F.col("inside") != (F.col("odd") == 1)
    opened = F.when(ends & (~F.col("inside") | F.col("last").isNotNull()), 1)
    state = state.withColumn("opened", opened)
    head = F.when(F.col("inside"), F.coalesce(F.sum("opened").over(before), F.lit(0))).alias("head")
    tail = F.when(F.col("opened") == 1, F.sum("opened").over(by_block.rowsBetween(Window.unboundedPreceding, 0))).alias("tail")
    return state.select("file", "block", "start", "inside", "first", "last", head, tail)


def open_splits(lines: DataFrame) -> list[tuple[str, int]]:
    """(file, block) of the splits that begin inside a quoted field."""
    return [(r["file"], r["block"]) for r in split_states(lines).filter("inside").select("file", "block").toLocalIterator()]


def _assembler(splits: list[tuple[int, bool, bool]], header: bool):
    """Lines (value, line) in the order of the scan -> the records that begin and end in one split
    (RECORDS). ``splits``: first line, begun inside a field, first of its file."""
    import numpy as np

    starts, inside, leads = (np.array(c, k) for c, k in zip(zip(*sorted(splits), strict=True) if splits else ((), (), ()), (np.int64, bool, bool), strict=True))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        # the split, its state, the record begun in it, whether a piece of one begun before still goes on, or the header is to come
        split, open_, held, piece, skip = -1, False, [], False, False

        def flush():
            """The record that ends where the split ends, if one does."""
            if held and not open_ and not skip:
                yield _batch(int(starts[split]), pa.array(["\n".join(held)], pa.string()))

        for batch in batches:
            values, lines = batch.column("value"), batch.column(LINE).to_numpy()
            if not len(values):
                continue
            here, end = (int(i) - 1 for i in np.searchsorted(starts, lines[[0, -1]], "right"))
            turns = np.searchsorted(lines, starts[here + 1:end + 1]).tolist()
            for at, lo, hi in zip(range(here, end + 1), [0, *turns], [*turns, len(values)], strict=True):
                part_of = values[lo:hi]
                if at != split:
                    yield from flush()
                    split, held = at, []
                    open_ = piece = bool(inside[at])
                    skip = header and not piece and bool(leads[at])
                state = (np.cumsum(pc.count_substring(part_of, QUOTE).to_numpy()) + open_) % 2 == 1
                begins = ~np.concatenate([[open_], state[:-1]])  # lines that begin a record
                heads = np.flatnonzero(begins)
                open_ = bool(state[-1])
                stop = int(heads[0]) if len(heads) else hi - lo
                if not piece:
                    held += part_of[:stop].to_pylist()
                if not len(heads):
                    continue
                if held:  # the record begun before ends here
                    if not skip:
                        yield _batch(int(starts[at]), pa.array(["\n".join(held)], pa.string()))
                    skip = False
                piece = False
                # all records but the last are whole; the last may go on in the next batch
                last = int(heads[-1])
                whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(heads - stop, pa.int32()), part_of[stop:last].cast(pa.string())), "\n")
                if skip and len(whole):
                    whole, skip = whole[1:], False
                if len(whole):
                    yield _batch(int(starts[at]), whole)
                held = part_of[last:].to_pylist()
        yield from flush()

    return run


def _batch(start: int, records):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(start, pa.int64()), len(records)), records], ["start", "record"])


def _pieces(lines: DataFrame, states: list[Row]) -> DataFrame:
    """(file, record): the records that cross splits, and one left open at a file's end."""
    ranges = []  # (partition, first and last line of a piece, its split, its record)
    for r in states:
        end = ((r["start"] >> PARTITION_BITS) + 1 << PARTITION_BITS) - 1 if r["end"] is None else r["end"]
        place = (r["start"] >> PARTITION_BITS, r["file"], r["block"])
        if r["head"] is not None:
            ranges.append((*place, r["head"], r["start"], end if r["first"] is None else r["first"]))
        if r["tail"] is not None:
            ranges.append((*place, r["tail"], r["last"], end))
    pieces = lines.sparkSession.createDataFrame(ranges, "partition long, file string, block long, number long, low long, high long")
    # the lines' numbers are those of split_states: a file scan's partitions keep their order
    line = lines.select("value", F.monotonically_increasing_id().alias(LINE))
    found = line.join(F.broadcast(pieces), (F.shiftright(LINE, PARTITION_BITS) == F.col("partition")) & F.col(LINE).between(F.col("low"), F.col("high")))
    joined = found.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", LINE, "value"))).alias("lines"))
    return joined.select("file", F.array_join(F.col("lines.value"), "\n").alias("record"))


def _records(spark: SparkSession, path: str, header: bool, named: bool) -> DataFrame:
    ensure_on_executors(spark)
    lines = _lines(spark, path)
    follows = Window.partitionBy(F.shiftright("start", PARTITION_BITS)).orderBy("start")
    states = split_states(lines).withColumn("end", F.lead("start").over(follows) - 1)
    crossing = F.col("head").isNotNull() | F.col("tail").isNotNull()
    # only splits that a record crosses need their file's name here
    states = states.withColumn("file", F.when(F.lit(named) | crossing, F.col("file"))).collect()
    splits = [(r["start"], r["inside"], r["block"] == 0) for r in states]
    placed = lines.select("value", F.monotonically_increasing_id().alias(LINE))
    out = placed.mapInArrow(_assembler(splits, header), RECORDS)
    if named and splits:
        names = spark.createDataFrame([(r["start"], r["file"]) for r in states], "start long, file string")
        out = out.join(F.broadcast(names), "start")
    else:
        out = out.withColumn("file", F.lit(None).cast("string"))
    out = out.select("file", "record")
    crossed = [r for r in states if r["head"] is not None or r["tail"] is not None]
    if crossed:
        out = out.unionAll(_pieces(lines, crossed))
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record <> ''")


def csv_records(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(file, record): the text of every CSV record, without its line end; blank lines are none. With
    ``header`` each file's first record is left out (it has to end in the file's first split)."""
    return _records(spark, path, header, True)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def read_csv_split(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table of CSV files with a header and quoted fields that may hold line ends: the rows of
    ``read_table``, with a task for each split of a file. Columns are strings without a schema; a schema
    may list the columns in any order, all of them. Quotes stand around whole fields only, doubled inside them."""
    columns = spark.read.csv(path, header=True, escape=QUOTE, quote=QUOTE).columns
    if schema is None:
        wanted = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    else:
        given = spark.createDataFrame([], schema).schema
        if sorted(given.names) != sorted(columns):
            raise ValueError(f"the file has the columns {', '.join(columns)}, the schema {', '.join(given.names)}")
        wanted = given
    by_place = ", ".join(f"{_quoted(c)} {wanted[c].dataType.simpleString()}" for c in columns)
    parsed = F.from_csv("record", by_place, {"quote": QUOTE, "escape": QUOTE, "multiLine": "true"})
    return _records(spark, path, True, False).select(parsed.alias("row")).select(*[F.col("row")[c].alias(c) for c in wanted.names])
