"""Benchmark the headline jobs; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3). Each job is timed warm (one untimed warm-up run),
written to the ``noop`` sink, median of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pagetide.session import get_spark  # noqa: E402
from pagetide.plans import queries as Q  # noqa: E402

R = Q.QUERIES
JOBS = {
    "url_inventory": lambda s, d: [R["url_inventory"](s, d)],
    "extract_pages_native": lambda s, d: [Q.scoped(Q.page_table)(s, d)],
    "extract_pages_python": lambda s, d: [R["extract_markdown"](s, d)],
    "map_diff_health": lambda s, d: [R["map_diff"](s, d), R["map_health"](s, d)],
    "page_docs_content_diff": lambda s, d: [R["content_diff"](s, d)],
    "keyword_summary": lambda s, d: [R["keyword_summary"](s, d)],
    "rank_tiers_search": lambda s, d: [R["top_pages"](s, d)],
    "miss_history": lambda s, d: [R["miss_history"](s, d)],
    "site_manifest": lambda s, d: [R["site_manifest"](s, d)],
}


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    for df in fn(spark, sf_dir):
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = set(sys.argv[1:])
    spark = get_spark(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": str(max(8, int(cpus)))})
    times = {}
    for name, fn in JOBS.items():
        if only and name not in only:
            continue
        run_once(spark, fn, sf_dir)  # warm-up
        times[name] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_job_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "spark": spark.version,
        "cpus": int(cpus),
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
