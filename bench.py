"""Time the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from lucidframe.catalog import QUERIES
from lucidframe.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "audit_duplicates", "dedup_keep_latest", "clean_projects", "project_summary", "by_region", "top_provinces", "drill_region",
    "src_feature_collection", "dedup_exact", "outliers_iqr", "merge_case_variants", "cleaning_report", "normalize_documents",
    "profile_columns", "profile_numeric", "profile_top_values", "detect_column_types", "unpivot_periods", "kpi_wide", "cagr",
    "multi_series_top5", "group_sum_top30", "time_series_sums", "pearson_strength", "insight_leader", "insight_group_skew",
    "insight_growth", "chart_recommendations", "executive_summary_facts", "filtered_reanalysis", "norm_min_two_nonnull",
    "text_table_cells", "document_table_cells", "grid_header_row", "grid_cells",
]


def timed(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed(spark, "by_region")  # start the JVM's compilers before timing
    seconds = {}
    for name in names:
        seconds[name] = round(statistics.median(timed(spark, name) for _ in range(RUNS)), 3)
        spark.catalog.clearCache()
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
