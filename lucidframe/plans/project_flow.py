"""Project records from raw input to written reports.

audit, deduplicate, clean, land as Parquet, validate, report. The clean table is
written once and read back, so every report scans a few columns of a columnar
table instead of repeating the deduplication.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from ..operators import audit, records, rollups
from ..sources.sinks import write_drilldown, write_parquet, write_report

# Fixed value: reports with a fixed number of rows, written as one file.
FIXED_SIZE = ("summary", "by_province", "top_contractors")


@dataclass
class FlowResult:
    nulls: Row
    duplicates: int
    validation: Row
    stages: dict[str, int]
    clean: DataFrame


def run(spark: SparkSession, raw: DataFrame, out: str, tie_break: list[str] | None = None, row_key: list[str] | None = None) -> FlowResult:
    """Run every stage and write under `out`: projects/, compact/, reports/<name>/, drill_region/, drill_year/."""
    nulls = audit.null_counts(raw).first()
    duplicates = audit.duplicate_count(raw, records.RECORD_KEY).first()["duplicate_rows"]
    write_parquet(records.clean_records(records.dedup_records(raw, tie_break), row_key), f"{out}/projects")

    clean = spark.read.parquet(f"{out}/projects")
    validation = audit.validate_no_nulls(clean).first()
    write_parquet(records.compact(clean), f"{out}/compact")
    for name, report in rollups.all_reports(clean).items():
        write_report(report, f"{out}/reports/{name}", single_file=name in FIXED_SIZE)
    write_drilldown(rollups.drill_region(clean), "region", f"{out}/drill_region")
    write_drilldown(rollups.drill_year(clean), "funding_year", f"{out}/drill_year")

    counts = audit.stage_counts({"clean": clean, "exported": records.with_cost(clean)}).collect()
    stages = {"raw": nulls["total_rows"], **{r["stage"]: r["row_count"] for r in counts}}
    return FlowResult(nulls, duplicates, validation, stages, clean)
