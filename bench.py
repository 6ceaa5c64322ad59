"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line. Each query is executed in full into Spark's no-op
sink (nothing is collected to the driver). Session start-up (JVM, and the
Python workers that Arrow-batched maps reuse) happens before timing."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import get_spark  # noqa: E402

HEADLINE = ["chunk_stats", "chunk_text", "chunk_sentences", "dataset_chunks", "clean_txt", "join_pages",
            "generate_qa", "embed_hashing", "mean_pool", "topk_batch", "qa_stats", "datapoint_json"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=cpus * 2)
    # Session start-up, not query time: a generic engine warm-up on synthetic
    # rows (no test tables): a string regex, a shuffle, and one Python worker
    # per core for the Arrow-batched maps.
    (spark.range(0, 200_000, 1, cpus)
     .selectExpr("regexp_replace(repeat(cast(id as string), 20), '1+', ' ') as s")
     .groupBy(F.length("s").alias("n")).count().collect())
    spark.range(0, cpus, 1, cpus).mapInPandas(lambda it: it, "id long").collect()
    first, times, errors = {}, {}, {}
    # the second run of each query counts, in an order rotated by half
    for name in [*names, *names[len(names) // 2:], *names[:len(names) // 2]]:
        t0 = time.time()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.time() - t0, 3)
            first.setdefault(name, took)
            times[name] = took
        except Exception as e:  # noqa: BLE001 - report the failure, keep measuring the rest
            times[name] = None
            errors[name] = repr(e)[:300]
    spark.stop()
    sf = sf_dir.rsplit("sf", 1)[-1]
    out = {"metric": "total_query_sec", "value": round(sum(v for v in times.values() if v is not None), 3),
           "unit": "sec", "queries": times, "first_run": first, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
