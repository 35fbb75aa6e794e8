"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is executed to completion with the ``noop`` sink (full
computation, nothing collected to the driver); the reported time is the
best of ``$BENCH_REPEAT`` runs after one warm-up of the session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "h07_hybrid_search", "h08_hybrid_search_basic", "h01_vector_topk", "h04_text_rank_cd", "h09_greedy_dedupe",
    "e01_click_totals", "e02_click_top_urls", "e04_pageview_totals", "e07_hourly_views", "e08_feedback_totals",
    "a07_upsert_by_key", "b18_page_text", "b05_page_links", "b13_product_fields", "b21_labelled_fields",
    "b27_origin_from_location", "i07_intent", "l01_log_stats", "k02_hourly_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    from shelfspark.plans import registry
    from shelfspark.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    registry.load_all()
    names = [n for n in HEADLINE if n in registry.QUERIES]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if re.search(only, n)]
    # warm-up: JVM, parquet footers, codegen caches
    registry.QUERIES["e03_click_by_env"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    # building the stored catalogue that the search queries scan (timed on its own)
    from shelfspark.sources import adapters
    t0 = time.perf_counter()
    adapters.stored(spark, sf_dir, "catalog", rebuild=True)
    times["catalog_build"] = round(time.perf_counter() - t0, 3)
    # ... and its inverted index (blocked postings), also timed on its own
    from shelfspark.plans import search
    t0 = time.perf_counter()
    search._index(spark, sf_dir, rebuild=True)
    times["term_index_build"] = round(time.perf_counter() - t0, 3)
    for n in names:
        best = None
        for _ in range(repeat):
            t0 = time.perf_counter()
            registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else None, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
