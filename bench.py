"""Headline queries, timed once each: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rebuyflow.catalog import all_queries  # noqa: E402
from rebuyflow.session import local_session  # noqa: E402

HEADLINE = ("latest_version", "unnest_items", "union_sources", "duplicate_accounting", "order_conflicts", "policy_rows", "item_lifecycle",
            "daily_events", "row_disposition", "episodes", "next_purchase_labels", "lineage_trace", "origin_features", "item_speed", "cadence_profile",
            "stable_routes", "timing_summary", "cart_policies", "grouped_report", "landmarks", "paired_bootstrap", "pair_ratchet", "schedule",
            "schedule_weekly", "daily_batch", "gbt_two_target")


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = all_queries(), {}
    queries["status_map"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's code paths
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
