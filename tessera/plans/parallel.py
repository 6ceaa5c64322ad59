"""Partitioning helper shared by the operators."""
from __future__ import annotations

from pyspark.sql import DataFrame

#: Session setting: deal rows into so many partitions before CPU-heavy work per row.
SPREAD = "spark.tessera.spreadPartitions"


def spread(df: DataFrame, key: str | list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Deal rows out for CPU-heavy work, if the caller or the session asks for it.

    An input that cannot be split (one Parquet row group) is one task. Whether
    that matters is known to whoever runs the job, so nothing is guessed from
    the plan here: ``partitions``, or the session setting ``SPREAD``, says how many
    partitions to deal into (by ``key`` when given, so retries are deterministic;
    pass the full unique key). Unset, as on a cluster reading many splits,
    the frame is returned as it is and no shuffle is added."""
    n = partitions or int(df.sparkSession.conf.get(SPREAD, "0"))
    if not n:
        return df
    if not key:
        return df.repartition(n)
    return df.repartition(n, *([key] if isinstance(key, str) else key))
