"""Target-distribution importance resampling over hashed word n-grams.

A text's words come from a pre-tokenizer of the ``tokenizers`` library: a regex split, which
needs no training, over the ASCII-lowered text gives every word with its byte offsets. Windows
of one to three neighbouring offset pairs are the features; a window's bucket is the CRC-32
of its words joined by one space, carried on from the shorter window's. The bucket histograms
of the corpus and of the target texts give every bucket a gain, a document's weight is
the sum of the gains of its features, and Gumbel noise by a hash of doc_id makes taking the
highest scores a draw without replacement.

Each document is split once: its buckets (two bytes a feature) are stored in the shared
folder, and the corpus histogram and the weights read them from there. A task sends one
histogram of ``BUCKETS`` figures; the gains (``BUCKETS`` figures) go through the driver.
Ranks come from a range-partitioned sort of (score, doc_id) rows, numbered by partition.

Defined cases: null text has no words; texts are split in blocks of about ``BLOCK`` code
points, parted where no word is, so a very long text needs bounded memory and gives the
same features; a null doc_id is the empty text in the hashed key and ranks behind every
other in a tie; rows that share a doc_id are drawn each, equal ones in any order; without
documents, or without target texts, the counts are zero and the formula holds; extra
columns are ignored."""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, stage
from tessera.operators.rows import zip_index

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = "\x00-\x2F\x3A-\x60\x7B-\x7F"  # what parts words once A-Z are lower-cased
LONGEST = 3  # words of a feature
BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
BLOCK = 1 << 20
_PART = re.compile(f"[{NO_WORD}]")


@lru_cache(maxsize=1)
def splitter():
    """Keeps the words of a text and drops what parts them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(f"[^{NO_WORD}]+"), "removed", invert=True)


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """A text in blocks of at least ``size`` code points, cut where no word is."""
    start = 0
    while len(text) - start > size:
        cut = _PART.search(text, start + size)
        if not cut:
            break
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def words_with_offsets(text: str) -> list[tuple[int, int]]:
    """Byte offsets of the words of a lower-cased text."""
    from tokenizers import PreTokenizedString

    split = PreTokenizedString(text)
    splitter().pre_tokenize(split)
    return [offsets for _, offsets, _ in split.get_splits("original", "byte")]


def feature_buckets(text: str | None, buckets: int = BUCKETS, block: int = BLOCK):
    """(number of words, bucket of every feature as an unsigned 16-bit array)."""
    from zlib import crc32

    import numpy as np

    found, n_words, carried = [], 0, []
    for part in blocks(text, block) if text else ():
        data = part.encode()
        new = [data[a:b] for a, b in words_with_offsets(part)]
        n_words += len(new)
        words = carried + new
        crcs = list(map(crc32, words))
        joined = [b" " + w for w in words]
        # windows that end in a word carried over were counted with their block
        found.append(crcs[len(carried):])
        for k in range(1, LONGEST):
            crcs = list(map(crc32, joined[k:], crcs))
            found.append(crcs[max(0, len(carried) - k):])
        carried = words[1 - LONGEST:]
    flat = np.concatenate([np.array(f, dtype=np.uint32) for f in found]) if found else np.zeros(0, np.uint32)
    return n_words, (flat % np.uint32(buckets)).astype("<u2")


def with_buckets(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, buckets): one row per document; buckets as little-endian unsigned 16-bit integers."""
    if buckets > 1 << 16:
        raise ValueError("a bucket is stored in two bytes")

    def split(batches: Iterable):
        import pyarrow as pa

        for batch in batches:
            counts, packed = [], []
            for text in batch.column(1):
                n, found = feature_buckets(text.as_py(), buckets)
                counts.append(n)
                packed.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n_words", "buckets"])

    lowered = F.translate("text", UPPER, LOWER).alias("text")
    return ship(docs).select(F.col("doc_id").cast("long"), lowered).mapInArrow(split, "doc_id long, n_words long, buckets binary")


def histogram(rows: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, <name>): features per bucket; a task sends one row a bucket that it has seen."""
    def counted(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column(0):
                total += np.bincount(np.frombuffer(packed.as_py(), "<u2"), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "n"])

    return ship(rows).select("buckets").mapInArrow(counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, s, t, gain) of every bucket, from with_buckets() rows of both; one row per bucket."""
    spark = corpus.sparkSession
    both = (spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
            .join(histogram(corpus, "s", buckets), "bucket", "left").join(histogram(target, "t", buckets), "bucket", "left").fillna(0, ["s", "t"]))
    counts = stage(both, "histograms")
    sums = counts.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()

    def plus(c, n):
        return (c + n).cast("double")

    ratio = plus(F.col("t"), 1) * float(sums["S"] + buckets) / (plus(F.col("s"), 1) * float(sums["T"] + buckets))
    return counts.select("bucket", "s", "t", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(rows: DataFrame, gains: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of with_buckets() rows."""
    import numpy as np

    table = np.zeros(buckets, dtype=np.int64)
    for r in gains.select("bucket", "gain").collect():  # one row per bucket
        table[r["bucket"]] = r["gain"]

    def weighed(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.frombuffer(packed.as_py(), "<u2") for packed in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array([int(table[f].sum()) for f in found], pa.int64())],
                ["doc_id", "n_words", "n_features", "weight"])

    return ship(rows).select("doc_id", "n_words", "buckets").mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED):
    """Gumbel noise in thousandths, from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document. docs (doc_id, text) are drawn
    towards the texts of target (text); rank 1, 2, ... of the drawn, others null."""
    rows = stage(with_buckets(docs), "buckets")
    aim = stage(with_buckets(target.select(F.lit(0).alias("doc_id"), "text")), "target")
    weighed = weights(rows, bucket_gains(rows, aim)).withColumn("score", F.col("weight") + noise(seed))
    # the eligible come first, so a place in this order is a rank among them
    sort_keys = weighed.select("*", (F.col("n_words") < least_words).alias("short"), (-F.col("score")).alias("low"), F.col("doc_id").isNull().alias("unnamed"))
    placed = zip_index(sort_keys, "place", ["short", "low", "unnamed", "doc_id"])
    drawn = placed.filter(~F.col("short")).count() * percent // 100
    rank = F.when(~F.col("short") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
