"""Combining sources: union by name, with or without missing columns."""
from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import DataFrame


def union_sources(frames: Iterable[DataFrame]) -> DataFrame:
    """Concatenate frames with the same columns (matched by name)."""
    return reduce(lambda a, b: a.unionByName(b), list(frames))


def union_missing_cols(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of records with different keys: the column set is the sorted union
    of all columns; a missing value is null (written as an empty CSV cell)."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), list(frames))
    return u.select(*sorted(u.columns))


def read_many(paths: Iterable[str], reader: Callable[[str], DataFrame]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Read several inputs; one that fails is recorded and skipped (the rest are
    unioned). Returns (frame or None, [(path, error)])."""
    ok, errors = [], []
    for p in paths:
        try:
            df = reader(p)
            df.schema  # resolve now, so a bad input fails here
            ok.append(df)
        except Exception as e:  # noqa: BLE001 - any read failure skips the input
            errors.append((p, repr(e)))
    return (union_sources(ok) if ok else None), errors
