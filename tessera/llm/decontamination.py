"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup.

Windows are as long as a benchmark item and lie where a document shares a word
shingle with it: a window without a shingle of any item has similarity 0, so
none that could count is left out. Each window, and each item, gets a 64-bit
SimHash of its words. Fingerprints are cut into four blocks of 16 bits; two that
differ in at most ``4 * (errors + 1) - 1`` bits agree in some block up to
``errors`` bits, so an index that files an item under every block value within
``errors`` bits finds all fingerprints within the radius. Candidates are then verified by
their exact weighted similarity: common shingle count (with multiplicity) over the
count of the union, at least 0.8.

Only SQL functions. Words are compared in lower case. Items of fewer than five words
are one shingle. Defined cases: null or blank items and texts match nothing;
windows are clipped at the ends of a document; items with the same words count
as the one with the smallest item_id; rows that repeat doc_id and text give their pairs once;
a null doc_id is carried as null; a very long text is one row, of which only the spans around
shared shingles go on; a similarity of exactly 0.8 counts; empty tables give an empty result; extra columns are
ignored, and kept by ``drop_contaminated``."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, stage, words_of

SHINGLE = 5
SIMILARITY = 0.8
BLOCK_ERRORS = 4
RADIUS = 4 * (BLOCK_ERRORS + 1) - 1  # all that the block indexes are complete to
NO_ID = -(1 << 63)
#: Up to so many distinct benchmark shingles (16 bytes each) are broadcast;
#: beyond, Spark joins by shuffle.
MOST_BROADCAST = 1_000_000

WORD_SIMHASH = """aggregate(sequence(0, 63), 0L, (f, b) -> f | if(
    2 * aggregate(hashes, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int)) > size(hashes), shiftleft(1L, b), 0L))"""


def simhash(words: Column, df: DataFrame, name: str) -> DataFrame:
    """Add the 64-bit SimHash of an array of words (a repeated word counts each time)."""
    return df.withColumn("hashes", F.transform(words, lambda w: F.xxhash64(w))).withColumn(name, F.expr(WORD_SIMHASH)).drop("hashes")


def shingles(words: Column, size) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(n >= size, runs).otherwise(F.array().cast("array<bigint>"))


def _lower_words(text: Column) -> Column:
    return words_of(F.lower(text))


def item_table(benchmark: DataFrame) -> DataFrame:
    """item (hash of the words), item_id, words, n, size (of its shingles) and print,
    stored; one row per distinct word sequence."""
    words = benchmark.select("item_id", _lower_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    one = words.groupBy(F.xxhash64("words").alias("item")).agg(F.min("item_id").alias("item_id"), F.first("words").alias("words"))
    one = one.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(SHINGLE)))
    return stage(simhash(F.col("words"), one, "print"), "items")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("mark"), "text")


def anchored_windows(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """(id, mark, first, last, words): the distinct item-sized word windows around
    shingles that a document shares with an item, aligned as in the item."""
    sizes = [r["size"] for r in items.select("size").distinct().collect()]  # 1 to SHINGLE
    if not sizes:
        sizes = [SHINGLE]
    each = reduce(DataFrame.unionAll, (
        items.filter(F.col("size") == k).select("n", F.lit(k).alias("size"), F.posexplode(shingles(F.col("words"), k)).alias("offset", "h"))
        for k in sizes))
    spots = stage(each.distinct(), "spots")
    known = stage(spots.select("size", "h").distinct(), "known")
    side = F.broadcast(known) if known.count() <= MOST_BROADCAST else known
    split = keyed.select("id", "mark", _lower_words(F.col("text")).alias("words"))
    hits = reduce(DataFrame.unionAll, (
        split.select("id", "mark", F.size("words").alias("total"), F.posexplode(shingles(F.col("words"), k)).alias("pos", "h"))
        .join(side.filter(F.col("size") == k), "h") for k in sizes))
    begin = F.col("pos") - F.col("offset")
    spans = hits.join(spots, ["size", "h"]).select(
        "id", "mark", F.greatest(begin, F.lit(0)).alias("first"), F.least(begin + F.col("n"), F.col("total")).alias("last")).distinct()
    spans = stage(spans.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    found = keyed.dropDuplicates(["id", "mark"]).join(spans, ["id", "mark"]).select("id", "mark", "spans", _lower_words(F.col("text")).alias("words"))
    cut = F.transform("spans", lambda s: F.struct(
        s["first"].alias("first"), s["last"].alias("last"), F.slice(F.col("words"), s["first"] + 1, s["last"] - s["first"]).alias("words")))
    return found.select("id", "mark", F.explode(cut).alias("w")).select("id", "mark", "w.first", "w.last", "w.words")


def within_radius(prints: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(print, item): all pairs whose fingerprints differ in at most ``radius`` bits,
    through four block indexes; radius is at most 4 * (BLOCK_ERRORS + 1) - 1."""
    def blocks(p):
        return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(p, 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(4)])

    near = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(0xFFFF).cast("long")), lambda m: F.bit_count(m) <= BLOCK_ERRORS)
    index = (items.select("item", F.col("print").alias("item_print"), F.explode(blocks("print")).alias("b"))
             .select("item", "item_print", "b.block", F.explode(F.transform(near, lambda m: m.bitwiseXOR(F.col("b.value")))).alias("value")))
    probes = prints.select("print").distinct().select("print", F.explode(blocks("print")).alias("b")).select("print", "b.block", "b.value")
    # the index grows with the benchmark and the probes with the corpus: neither is broadcast
    close = probes.join(index.hint("merge"), ["block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    return close.select("print", "item").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, mark, doc_id, item_id, first_word, n_words, similarity): for each
    document and item the most similar window of at least ``similarity``."""
    items, keyed = item_table(benchmark), _keyed(docs)
    windows = simhash(F.col("words"), anchored_windows(keyed, items), "print")
    windows = stage(windows.withColumn("window", F.xxhash64("id", "mark", "first", "last")), "windows")
    pairs = windows.select("window", "print", "words").join(within_radius(windows, items, radius), "print")
    pairs = pairs.join(items.select("item", F.col("n").alias("item_n"), "size"), "item")
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1), lambda i: F.array_join(F.slice("words", i, F.col("size")), " "))
    own = (pairs.filter(F.size("words") >= F.col("size")).select("window", "item", "item_n", "size", F.size("words").alias("n"), F.explode(runs).alias("shingle"))
           .groupBy("window", "item", "item_n", "size", "n", "shingle").agg(F.count("*").alias("here")))
    theirs = items.select("item", F.explode(runs).alias("shingle")).groupBy("item", "shingle").agg(F.count("*").alias("there"))
    common = own.join(theirs, ["item", "shingle"]).groupBy("window", "item", "item_n", "size", "n").agg(F.sum(F.least("here", "there")).alias("common"))
    union = (F.col("n") - F.col("size") + 1) + (F.col("item_n") - F.col("size") + 1) - F.col("common")
    good = common.select("window", "item", (F.col("common") / union).alias("similarity")).filter(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("first", "last"), F.struct("similarity", -F.col("first"), -F.col("last")))
    found = good.join(windows.drop("words", "print"), "window").join(items.select("item", "item_id"), "item").groupBy("id", "mark", "item", "item_id").agg(
        best.alias("w"), F.max("similarity").alias("similarity"))
    return found.select("id", "mark", F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "item_id", F.col("w.first").alias("first_word"),
                        (F.col("w.last") - F.col("w.first")).alias("n_words"), "similarity")


def leaked_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity)."""
    return leaks(docs, benchmark).select("doc_id", "item_id", "first_word", "n_words", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all columns, that hold no benchmark item."""
    key, hash_ = free_name(docs, "id", "mark")
    bad = stage(leaks(docs, benchmark).select(F.col("id").alias(key), F.col("mark").alias(hash_)).distinct(), "leaked")
    marked = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(hash_, F.xxhash64("text"))
    return marked.join(bad, [key, hash_], "left_anti").select(docs.columns)
