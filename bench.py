"""Times the headline queries and prints one JSON line.

Each query runs end to end from the parquet tables, once per repetition after a warm-up
query, into a sink that discards rows; the best repetition counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from perexpo.plans.queries import QUERIES

HEADLINE = (
    "profile_nulls_lineitem",
    "profile_fd",
    "profile_duplicates",
    "profile_distinct_parts",
    "clean_int",
    "exposure_totals",
    "period_metrics",
    "coord_clusters",
    "nearest_site",
    "distance_histogram",
    "triage_summary",
    "crosswalk_report",
    "pip_join",
    "site_metrics",
    "rank_rate_min",
    "site_period_metrics",
    "rank_site_period",
    "pearson_lineitem",
    "spearman_lineitem",
    "residuals",
    "full_analysis",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("perexpo-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("profile_rows")
    seconds = {name: round(min(run(name) for _ in range(repeat)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
