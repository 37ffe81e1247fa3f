"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Every query runs to its full result, which is discarded; the figure is the
median of three runs after one warm-up run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shiftcast.plans.registry import all_queries  # noqa: E402
from shiftcast.session import local_session  # noqa: E402

HEADLINE = [
    "next_day_staffing",
    "hourly_counts",
    "dense_workload",
    "wide_workload",
    "feature_table",
    "holiday_features",
    "task_staffing",
    "hourly_staffing_plan",
    "scenarios_replan",
    "accuracy_tracker",
    "forecast_accuracy_summary",
    "diagnostic_summary",
    "decomposition",
    "autocorrelation",
    "validation_findings",
    "record_intervals",
    "value_quantiles",
    "column_profile",
    "activity_sessions",
    "lockouts",
    "seasonal_regression_forecast",
    "recursive_forecast",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "shiftcast-bench")
    queries = all_queries()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(RUNS + 1):
            begin = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median wall times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
