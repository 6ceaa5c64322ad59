"""Embedding: a pluggable encoder run as an Arrow-batched iterator pandas UDF,
plus mean pooling and dimension checks as native aggregations.

Encoder protocol: ``factory() -> encoder`` (called once per task, so a model
is loaded once per executor task, not per row) and
``encoder.encode(list[str], max_tokens=512) -> np.ndarray (n, d)``; an encoder
truncates each text to ``max_tokens`` of its own tokens (one whose ``encode`` takes
no such argument is called without it). ``encoder.count_tokens(list[str])``, if it exists,
gives the lengths that batches by token budget go by."""
from __future__ import annotations

import hashlib
import inspect
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tessera.session import ensure_on_executors

DEFAULT_BATCH_SIZE = 32
MAX_TOKENS = 512
LOOKAHEAD = 4096  # texts that wait to be batched by length
SLICE_BATCHES = 32  # batches of fixed size whose vectors leave together
CACHED_TOKENS = 1 << 16  # that HashingEncoder remembers
POOL_EPS = 1e-9


def token_counter(encoder, max_tokens: int = MAX_TOKENS) -> Callable[[list[str]], np.ndarray]:
    """Tokens of each text as the encoder cuts it: its own ``count_tokens(list[str])`` if it has one, else words."""
    count = getattr(encoder, "count_tokens", None) or (lambda texts: [len(t.split()) for t in texts])
    return lambda texts: np.minimum(np.asarray(count(texts), dtype=np.int64).reshape(-1), max_tokens)


def budget_batches(lengths: np.ndarray, token_budget: int) -> list[np.ndarray]:
    """Places of the texts of each batch, from the shortest texts to the longest: as many as fit, each padded to the
    longest of its batch, in ``token_budget`` tokens; a text longer than that is a batch of its own."""
    order = np.argsort(lengths, kind="stable")
    out, start = [], 0
    for k, longest in enumerate(lengths[order].tolist()):
        if k > start and (k - start + 1) * max(longest, 1) > token_budget:
            out.append(order[start:k])
            start = k
    if len(order):
        out.append(order[start:])
    return out


def embed(df: DataFrame, encoder_factory: Callable[[], object], text_col: str = "chunk",
          out_col: str = "embedding", batch_size: int = DEFAULT_BATCH_SIZE, max_tokens: int = MAX_TOKENS,
          token_budget: int | None = None, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Append ``out_col`` (array<float>) computed by the plug-in encoder in
    batches of ``batch_size`` texts of at most ``max_tokens`` tokens each. Null text gives a null vector.

    With ``token_budget`` up to ``lookahead`` texts of an Arrow batch are batched by length instead (see
    ``budget_batches``), so a long text does not pad short ones; the vectors stand in the order of the rows."""

    ensure_on_executors(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def enc(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder_factory()
        limit = {"max_tokens": max_tokens} if "max_tokens" in inspect.signature(model.encode).parameters else {}
        for texts in it:
            for values in _slices(texts, lookahead if token_budget is not None else batch_size * SLICE_BATCHES):
                out = [None] * len(values)
                idx = [i for i, t in enumerate(values) if t is not None]
                for part in _parts(model, values, idx, batch_size, max_tokens, token_budget, lookahead):
                    vecs = np.asarray(model.encode([values[i] for i in part], **limit), dtype=np.float32)
                    for j, i in enumerate(part):
                        out[i] = vecs[j]
                yield pd.Series(out, dtype=object)

    # a model call: never duplicated or moved by the optimizer
    return df.withColumn(out_col, enc.asNondeterministic()(F.col(text_col)))


def _slices(texts: pd.Series, limit: int) -> Iterator[list]:
    """The texts in slices of ``limit`` that are not null, so vectors leave Python before the whole Arrow batch has its own."""
    ends = np.flatnonzero(texts.notna().to_numpy())[limit - 1::limit] + 1
    for lo, hi in zip([0, *ends.tolist()], [*ends.tolist(), len(texts)], strict=True):
        if lo < hi or not len(texts):
            yield texts.iloc[lo:hi].tolist()


def _parts(model, values: list, idx: list[int], batch_size: int, max_tokens: int, token_budget: int | None, lookahead: int) -> Iterator[list[int]]:
    """Batches of the places ``idx`` of texts in ``values``."""
    if token_budget is None:
        for lo in range(0, len(idx), batch_size):
            yield idx[lo:lo + batch_size]
        return
    count = token_counter(model, max_tokens)
    for lo in range(0, len(idx), lookahead):
        queue = idx[lo:lo + lookahead]
        for part in budget_batches(count([values[i] for i in queue]), token_budget):
            yield [queue[k] for k in part.tolist()]


def padding_report(df: DataFrame, encoder_factory: Callable[[], object], text_col: str = "chunk", batch_size: int = DEFAULT_BATCH_SIZE,
                   max_tokens: int = MAX_TOKENS, token_budget: int | None = None, lookahead: int = LOOKAHEAD) -> DataFrame:
    """What ``embed`` would hand its encoder with the same options, without calling it, in one row: n_texts,
    n_batches, tokens, padded_tokens (every text counted as long as the longest of its batch), most_padded (of one batch)."""
    ensure_on_executors(df.sparkSession)

    def measured(it):
        model = encoder_factory()
        count = token_counter(model, max_tokens)
        for batch in it:
            values = batch["text"].tolist()
            idx = [i for i, t in enumerate(values) if t is not None]
            lengths = [count([values[i] for i in part]) for part in _parts(model, values, idx, batch_size, max_tokens, token_budget, lookahead)]
            yield pd.DataFrame({"n": [len(x) for x in lengths], "t": [int(x.sum()) for x in lengths], "p": [len(x) * int(x.max()) for x in lengths]})

    batches = df.select(F.col(text_col).alias("text")).mapInPandas(measured, "n long, t long, p long")
    zero = F.lit(0).cast("long")
    return batches.agg(*[F.coalesce(c, zero).alias(name) for name, c in (
        ("n_texts", F.sum("n")), ("n_batches", F.count(F.lit(1))), ("tokens", F.sum("t")), ("padded_tokens", F.sum("p")), ("most_padded", F.max("p")))])


class HashingEncoder:
    """Model-free stand-in encoder: whitespace tokens counted into ``dim``
    md5 buckets (bucket = first 8 hex digits of md5(token) mod dim)."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def _b(self, tok: str) -> int:
        b = self._bucket.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dim
            if len(self._bucket) < CACHED_TOKENS:
                self._bucket[tok] = b
        return b

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for r, t in enumerate(texts):
            toks = t.split()
            if toks:
                out[r] = np.bincount([self._b(tok) for tok in toks], minlength=self.dim)
        return out


def mean_pool(tokens: DataFrame, key: str = "key", vec_col: str = "embedding", mask_col: str = "mask",
              out_col: str = "embedding") -> DataFrame:
    """Masked mean of token vectors per key: sum(mask * v) / max(sum(mask), 1e-9)
    per dimension. Long form (key, dim) with partial aggregation, so a key with
    a huge number of tokens is pre-combined in every task; the final per-key
    regroup holds only one value per dimension."""
    long_ = tokens.select(key, F.col(mask_col).cast("double").alias("__m"),
                          F.posexplode(vec_col).alias("__d", "__v"))
    per_dim = long_.groupBy(key, "__d").agg(
        (F.sum(F.col("__v").cast("double") * F.col("__m")) /
         F.greatest(F.sum("__m"), F.lit(POOL_EPS))).alias("__p"))
    return per_dim.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__d", "__p"))), lambda x: x["__p"]).alias(out_col))


def embedding_dim(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Vector count, dimension, and how many distinct widths occur (must be 1)."""
    return df.agg(F.count(vec_col).alias("n_vectors"), F.min(F.size(vec_col)).alias("dim"),
                  F.count_distinct(F.size(vec_col)).alias("n_widths"))


def require_single_dim(df: DataFrame, vec_col: str = "embedding") -> int:
    r = embedding_dim(df, vec_col).first()
    if r["n_widths"] > 1:
        raise ValueError(f"vectors of {r['n_widths']} different widths in {vec_col}")
    return int(r["dim"] or 0)
