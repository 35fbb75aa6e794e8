"""Summarise the physical plans of key registered queries (what a reviewer checks for scale).

usage: python tools/plan_summary.py [sf_dir] [name ...]
For each query: shuffles, broadcasts, partition pruning, top-k, Python kernels, and the pushed
filters / read schema of each parquet scan.  Runs each query once so AQE shows its final plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelfspark.plans import registry  # noqa: E402
from shelfspark.session import get_spark  # noqa: E402

DEFAULT = ["e02_click_top_urls", "a07_upsert_by_key", "h01_vector_topk", "h04_text_rank_cd", "h07_hybrid_search",
           "b18_page_text", "f03_running_stats", "b08_listing_links"]
MARKERS = {
    "shuffle": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobinPartitioning",
    "single-partition exchange": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "partial aggregate": r"partial_",
    "window group limit (top-k before shuffle)": r"WindowGroupLimit",
    "take ordered (top-k)": r"TakeOrderedAndProject",
    "dynamic partition pruning": r"dynamicpruningexpression\((?!true)",
    "python kernel": r"FlatMapCoGroupsInPandas|MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython",
    "cartesian / nested loop": r"CartesianProduct|BroadcastNestedLoopJoin",
}


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    names = args or DEFAULT
    registry.load_all()
    spark = get_spark()
    for n in names:
        df = registry.QUERIES[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {n}")
        for label, pat in MARKERS.items():
            k = len(re.findall(pat, plan))
            if k:
                print(f"- {label}: {k}")
        for scan in sorted(set(re.findall(r"FileScan parquet \[[^\]]*\].*?ReadSchema: struct<[^>]*>", plan))):
            cols = re.search(r"ReadSchema: (struct<[^>]*>)", scan).group(1)
            pushed = re.search(r"PushedFilters: (\[[^\]]*\])", scan)
            part = re.search(r"PartitionFilters: (\[[^\]]*\])", scan)
            print(f"- scan {cols[:110]}" + (f" pushed={pushed.group(1)[:90]}" if pushed and pushed.group(1) != "[]" else "")
                  + (" partition-pruned" if part and "dynamicpruning" in part.group(1) else ""))
        print()
    spark.stop()


if __name__ == "__main__":
    main()
