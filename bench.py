"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``), ``BENCH_CPUS`` (default 8) and
``BENCH_QUERIES`` (names, comma-separated; default: the headline list).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from weblode.session import session  # noqa: E402

HEADLINE = [
    "parse_access", "malformed_count", "parse_errors", "agent_counts", "filter_conjunction", "top_endpoints_week",
    "top_endpoints", "top_referrers_web", "version_counts", "hour_counts", "dimension_counts", "totals_and_rates",
    "size_histogram", "activity_buckets", "activity_all_time", "adaptive_buckets", "trend_consolidated",
    "bins50_requests", "bins50_success", "downsample", "geo_range_join", "location_counts", "filter_location",
    "unknown_ips", "error_search", "csv_rows", "host_history", "report_counts", "stream_activity",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()

    taken = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            best = elapsed if best is None else min(best, elapsed)
        taken[name] = round(best, 4)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(taken.values()), 3),
        "unit": "sec",
        "queries": taken,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
