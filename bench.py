"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query is run in full into a sink that discards rows. One untimed run of the flagship warms the
JVM first; after that each query is timed once, including its planning.
"""

from __future__ import annotations

import json
import os
import time

from orderflow.plans.catalog import QUERIES
from orderflow.session import build_session, staging_scope

HEADLINE = [
    "V9_to_dlq",
    "E9_to_wire_json",
    "D1_dedup_first",
    "T5_region_window_metrics",
    "T7_route_late",
    "T10_sessions",
    "T11_tick_window_stats",
    "F3_online_latest",
    "F5_point_in_time",
    "F6_customer_history",
    "O11_latency_percentiles",
    "O12_latency_by_operator",
    "O16_throughput_in_out",
    "E13_items_count_check",
    "Q2_unaccounted_per_window",
    "Q5_conservation",
    "Q9_reconcile_totals",
    "Q12_key_difference",
    "Q19_profile_columns",
    "L1_evaluate_alarms",
    "K1_write_processed",
    "K3_write_aggregations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    small_dir = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, **{"orderflow.input.partitions": cpus})

    def run(name: str, where: str = sf_dir) -> float:
        start = time.perf_counter()
        with staging_scope(spark):
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    def raw_orders(where: str) -> int:
        with staging_scope(spark):
            return QUERIES["S3_read_envelopes"](spark, where).count()

    flagship = "T5_region_window_metrics"
    run(flagship)
    took = {name: run(name) for name in HEADLINE}
    raw_rows = raw_orders(sf_dir)
    extra = {}
    if small_dir and os.path.isdir(small_dir):
        # What each further order costs, without the fixed cost of planning and starting jobs.
        more = raw_rows - raw_orders(small_dir)
        marginal = {name: round(more / max(took[name] - run(name, small_dir), 1e-3)) for name in HEADLINE}
        extra = {"flagship_marginal_orders_per_sec": marginal[flagship], "marginal_orders_per_sec": marginal}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "raw_orders": raw_rows,
                "flagship_orders_per_sec": round(raw_rows / took[flagship]),
                **extra,
            }
        )
    )


if __name__ == "__main__":
    main()
