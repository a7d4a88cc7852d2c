"""Benchmark of the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` into Spark's ``noop`` sink (the full plan executes, nothing
is collected; the oracle-comparison rounding of the registry is not
applied), takes the median of ``$BENCH_RUNS`` runs (default 3) after one
warm-up run per query on the smallest data set, and prints one JSON line.
``BENCH_BROADCAST=off`` joins without broadcasts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_table",          # E1: daily -> dense grid -> all features
    "daily_sales",
    "dense_grid",
    "txn_enriched",
    "promo_running_max",
    "eda_results",
    "promotion_summary",
    "date_item_matrix",
    "concentration_curve",
    "demand_label",
    "outlier_flags",
    "kalman_smoothing",
    "scenario_sweep",
    "numeric_summary",
    "harmonic_smoothing",
    "orders_csv_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE

    from tillcast.plans.registry import load_all
    from tillcast.session import build_session

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "16g")})
    if os.environ.get("BENCH_BROADCAST") == "off":  # as with tables too large to broadcast
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(key, "-1")
    reg = load_all()
    # warm-up: each query once on the smallest sibling data set (JIT, generated
    # classes), so the timed runs measure execution rather than compilation
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm_dir = small if os.path.isdir(small) else sf_dir
    for name in names:
        reg[name].build(spark, warm_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in names:
        q = reg[name]
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
