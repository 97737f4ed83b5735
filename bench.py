"""Times the headline reconciliation queries and prints one line of JSON.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Each query runs once untimed and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from congruity.plans.catalog import QUERIES

HEADLINE = (
    "l2_volume_checks", "l2_key_stats_composite", "l3_status_counts", "l3_pairs_with_duplicates", "l3_coverage_metrics", "l3_secondary_match", "l3_group_recon",
    "l4_exact", "l4_field_stats", "l4_duplicate_pairs", "l5_global", "l5_grouped_tolerance", "l6_pattern", "l6_validity_range", "dq_distribution", "run_rollup",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
