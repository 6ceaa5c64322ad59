"""Summarise the physical plan of catalogue queries: shuffles, broadcasts,
Python stages, pushed and partition filters, and scanned columns.

usage: python -m tessera.plans.explain [sf_dir] [key ...]   (prints a markdown table)"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from tessera.plans.catalog import QUERIES  # noqa: E402
from tessera.session import get_spark  # noqa: E402


def summarize(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)[^\n]*", plan)
    scans = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    pushed = [p for p in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if p]
    parts = [p for p in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if p]
    return {
        "shuffles": len(shuffles), "kinds": sorted(set(s.split("(")[0] for s in shuffles)),
        "broadcasts": plan.count("BroadcastExchange"),
        "python": len(re.findall(r"(MapInPandas|ArrowEvalPython|BatchEvalPython|MapInArrow)", plan)),
        "scans": scans, "pushed": pushed, "partition_filters": parts,
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 and "/" in sys.argv[1] else "/root/testdata/sf0.01"
    keys = [a for a in sys.argv[1:] if "/" not in a] or sorted(QUERIES)
    spark = get_spark("local[8]", shuffle_partitions=16)
    print("| query | shuffles | broadcasts | python stages | scanned columns | pushed / partition filters |")
    print("| --- | --- | --- | --- | --- | --- |")
    for k in keys:
        s = summarize(QUERIES[k](spark, sf))
        cols = "; ".join(sorted(set(re.sub(r"struct<|>", "", x) for x in s["scans"]))) or "–"
        filt = "; ".join(s["pushed"] + [f"partition: {p}" for p in s["partition_filters"]]) or "–"
        kinds = f" ({', '.join(s['kinds'])})" if s["kinds"] else ""
        print(f"| `{k}` | {s['shuffles']}{kinds} | {s['broadcasts']} | {s['python']} | {cols[:120]} | {filt[:160]} |",
              flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
