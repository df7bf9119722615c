"""Benchmark: run the headline queries and print one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, optional)
Each query is fully executed (``noop`` sink: every row computed, nothing
collected); the JVM is warmed up first on sf0.001 with three query shapes
(windows + Python scan, positional sort, wide aggregate), timed separately.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_features",       # flagship: Elo + long table + momentum + EWM + regroup + diffs
    "venue_history",        # W1-W7
    "long_features",        # W8-W19
    "elo_pre",              # G1
    "skeleton_with_value",  # U2, X1-X3, J2, J3, A1
    "page_links",           # X5 over whole pages
    "team_key",             # X1 over distinct document words
    "time_split",           # D1 positional index
    "impute_median",        # A4 exact medians
    "corr_matrix",          # A6
    "class_metrics",        # A10-A13
    "gaussian_nb",          # M8
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from pitchline.plans.registry import QUERIES
    from pitchline.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    spark.sparkContext.setLogLevel("ERROR")
    t0 = time.time()
    for w in ("match_features", "time_split", "corr_matrix"):
        QUERIES[w](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    warm = time.time() - t0
    times = {}
    for n in names:
        t = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus, "warmup_sec": round(warm, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
