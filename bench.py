"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver).  One warm-up pass runs first so JVM start-up
and code generation are not counted; then ``$BENCH_REPEAT`` passes (default 3) over
all queries are timed; median, least and spread of each query are reported.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans.catalog import all_queries  # noqa: E402
from ledgerline.session import get_session  # noqa: E402

HEADLINE = [
    "s01_event_log_scan",
    "t01_poll_batch",
    "a01_status_counts",
    "a04_health",
    "a11_latency_percentiles",
    "m04_handle_failure",
    "m10_purge_batches",
    "r01_delivery_step",
    "w01_projection_dedup",
    "w01_projection_as_delivered",
    "m11_upsert_snapshot",
    "w05_status_history",
    "w08_greedy_chunks",
    "x06_typed_decode",
    "w10_rolling_failure_rate",
    "f14_sensitive_scan",
    "j11_order_payment_match_batch",
    "r07_saga_state",
    "j07_drift_read_vs_write",
    "a20_stock_decrement",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", app="ledgerline-bench",
                        shuffle_partitions=int(cpus) * 2,
                        extra={"spark.driver.memory": "16g"})
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    for n in names:  # warm-up
        qs[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    runs = {n: [] for n in names}
    for _ in range(repeat):  # passes over all queries, so a slow moment does not hit one query's runs only
        for n in names:
            t0 = time.perf_counter()
            qs[n].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[n].append(time.perf_counter() - t0)
    times = {n: round(statistics.median(r), 4) for n, r in runs.items()}
    least = {n: round(min(r), 4) for n, r in runs.items()}
    spread = {n: round(max(r) - min(r), 4) for n, r in runs.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "min": least, "spread": spread, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
