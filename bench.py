"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the
local cores (default: all). Every query runs to its last row into a no-op sink; the
best of BENCH_REPEAT runs counts, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "bucket_hour_sum",
    "bucket_day_first",
    "bucket_month_rate",
    "bucket_grouped",
    "bucket_grouped_nested",
    "filter_or_nested",
    "filter_bucket_nested_path",
    "breakdown_subject_sum",
    "breakdown_dimension_topk",
    "dimension_values",
    "subject_stats",
    "event_page_next",
    "series_cumulative",
    "ingest_accepted",
    "ingest_duplicates",
    "assignment_asof",
    "usage_counters",
    "usage_counters_years",
    "quota_progress",
    "quota_check",
    "quota_transitions",
    "plan_preview_summary",
    "alert_grouped",
    "alert_backtest",
    "prune_dry_run",
    "stream_tumbling_hour",
    "stream_ingest",
]


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    from meterframe.plans import QUERIES
    from meterframe.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = [n for n in sys.argv[1:] if n in QUERIES] or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=os.cpu_count() if cpus == "*" else int(cpus),
        extra={"spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR"},
    )
    QUERIES["bucket_day_sum"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        times = []
        for _ in range(repeat):
            begin = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(min(times), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rpartition("sf")[2],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
