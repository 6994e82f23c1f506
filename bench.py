"""Time the headline queries: python bench.py

Reads $BENCH_SF_DIR, runs on local[$BENCH_CPUS] and prints one JSON line. The ticketing tables are
derived and stored once ("setup_sec"), as a user's tables are; then every query is run to the end
with all its columns (noop sink). A query's time is the median of its warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from turnstile.plans import streams  # noqa: E402, F401  (registers the streaming queries)
from turnstile.plans.catalog import QUERIES  # noqa: E402
from turnstile.session import build_session, scratch_path  # noqa: E402
from turnstile.sources.fixtures import StoredTables, load, store  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "event_stats_summary", "organizer_dashboard", "organizer_recent_events", "daily_revenue", "event_listing",
    "event_detail", "event_sales_by_ticket_type", "ticket_availability", "promo_quote", "registration_search",
    "ticket_confirmation", "cancel_registrations", "counter_audit", "admit_registrations",
    "admit_registrations_public", "oversold_requests", "classify_scans", "checkin_summary", "marketplace_listing",
    "reconcile_webhooks", "payment_status", "payment_history", "effective_permissions", "apply_patches",
    "rate_violations", "cascade_delete", "constraint_audit", "assign_ticket_codes", "stream_scans",
]


def main() -> None:
    spark = build_session(
        "turnstile-bench",
        f"local[{CPUS}]",
        **{
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    start = time.perf_counter()
    folder = scratch_path(spark, "bench-tables")
    store(load(spark, SF_DIR), folder)
    tables = StoredTables(spark, SF_DIR, folder)
    setup = time.perf_counter() - start
    print("setup", round(setup, 3), file=sys.stderr, flush=True)
    took = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](tables).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds, median of warm runs per query",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "setup_sec": round(setup, 3),
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
