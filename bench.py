"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (input folder), BENCH_CPUS (local threads), BENCH_QUERIES (comma list).
Each query is run once to warm up and then timed, building and execution together: the median of
three runs, or a single run when that takes longer than SLOW seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorspark.plans import catalog  # noqa: E402
from sensorspark.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
SLOW = 4.0

HEADLINE = [
    "clean_energy",
    "calendar_features",
    "hourly_rollup",
    "energy_rollup",
    "master_join",
    "daily_master",
    "dataset_overview",
    "six_number_summary",
    "hour_profile",
    "zone_stats",
    "station_median",
    "building_stats",
    "correlation_matrix_long",
    "aqi_histogram",
    "lm_trend_by_level",
    "filtered_hourly",
    "sample_n_points",
    "hour_spine_gaps",
    "daily_patterns",
    "row_positions",
    "rolling_mean_events",
    "model_features",
    "zscore_flags",
    "iqr_flags",
    "trailing_flags",
    "mahalanobis_flags",
    "severity_scored",
    "method_summary",
    "pca_variance",
    "kmeans_days",
    "silhouette_exact",
    "loess_trend",
    "knn_distance",
    "dbscan_clusters",
    "rf_traffic_metrics",
    "stream_hourly_rollup",
]


def run_once(spark, name: str) -> float:
    started = time.perf_counter()
    df = catalog.QUERIES[name](spark, SF_DIR)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in names:
        run_once(spark, name)
        times = [run_once(spark, name)]
        while times[0] < SLOW and len(times) < 3:
            times.append(run_once(spark, name))
        took[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
