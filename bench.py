"""Time the headline queries and print one JSON line.

Each query runs once to warm up (code generation, Python workers, file cache)
and is then timed; the best of BENCH_REPEAT runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = (
    "sliding_windows",
    "sliding_windows_single_series",
    "trend_seasonal",
    "trend_seasonal_single_series",
    "scale_standard",
    "forecast_metrics",
    "pa_k_table",
    "ranking_metrics",
    "dominant_periods",
    "exponential_smoothing",
    "augment_jitter",
    "augment_permutation",
    "dtw_symmetric_band",
    "seasonal_residual_alerts",
    "stream_scores",
)


def main() -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for run in range(repeat + 1):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            if run > 0:
                best = min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
