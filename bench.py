"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
Every query writes its whole result to the no-op sink, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import time

from outlay.plans import registered
from outlay.session import local_session

HEADLINE = (
    "rollup_grouping_sets",
    "spend_by_vendor",
    "spend_by_jurisdiction_month",
    "platform_totals",
    "concentration_by_department",
    "spikes_jurisdiction",
    "yoy_by_jurisdiction",
    "budget_vs_actual",
    "operational_vendors",
    "vendor_profile_recent",
    "search_page",
    "search_count",
    "normalize_transactions",
    "resolve_vendors",
    "watch_events_core",
    "watch_events_views",
    "run_anomalies",
    "store_upsert",
    "stream_totals",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus, "16g")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    queries, seconds = registered.queries(), {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
