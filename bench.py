"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a ``noop`` write (no rows go to the
driver). Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d5_diff_snapshots",      # diff of two snapshots (the flagship)
    "d9_line_changes",        # line-level change counts of modified assets
    "p1_build_assets",        # asset rows: MIME, charset, dates, hash, references
    "e5_link_edges",          # link graph
    "r1_resolve_redirects",   # iterative redirect resolution
    "f9_crawl_closure",       # iterative crawl closure (all hosts at once)
    "b2_robots_allowed",      # robots.txt extraction
    "v2_resolve_requests",    # archive lookup
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    from sitelens.plans.registry import QUERIES
    from sitelens.session import get_spark
    spark = get_spark(app="sitelens-bench")
    # warm-up on the smallest test folder: JIT, generated code, Python workers,
    # and the per-process column expressions (not counted)
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("r6_content_hash", "p1_build_assets", "d5_diff_snapshots"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    # derived inputs that several queries share are made and timed apart, so no query's figure depends on the order
    from sitelens.plans import fixtures as FX
    t0 = time.perf_counter()
    FX.snapshots(spark, sf_dir)
    FX.hosted_pages(spark, sf_dir)
    fixtures = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "fixtures_sec": fixtures,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
