"""Cleaning of project records: defaults, casts and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from ..functions.dates import epoch_ms_date, tolerant_date
from .dedup import keep_latest

# Default text per column, the dedup order, the cost-view columns.
DEFAULTS = {
    "contract_id": "",
    "region": "Unknown Region",
    "province": "Unknown Province",
    "municipality": "Unknown Municipality",
    "project_description": "No Description",
    "type_of_work": "Unclassified",
    "infra_type": "Unclassified",
    "program": "",
    "funding_year": "",
    "start_date": "",
    "completion_date_actual": "",
    "contractor": "Unknown Contractor",
    "implementing_office": "",
    "district_engineering_office": "",
    "legislative_district": "",
}
RECORD_KEY = ["project_id", "contract_id"]
NEWEST_FIRST = ["infra_year", "completion_year"]
SURROGATE_PREFIX = "UNK-"
COMPACT_COLUMNS = [
    "region", "province", "municipality", "type_of_work", "funding_year", "contract_cost",
    "abc", "cost_savings", "is_delayed", "duration_days", "contractor", "project_description",
]


def text_or(c: Column, default: str) -> Column:
    """Spaces trimmed, null replaced. An empty string is a value here and stays."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(default))


def number_or_zero(c: Column, dtype: str) -> Column:
    value = F.coalesce(c, F.lit(0))
    # Integer casts cut the fraction; round half to even first.
    return (F.bround(value) if dtype in ("int", "bigint") else value).cast(dtype)


def surrogate_key(row_key: list[str]) -> Column:
    """A key for rows without one, made from the row itself.

    Numbering the rows would need one global order in one task, and would give
    other numbers when a lost executor's work is redone. A digest does neither.
    """
    parts = [F.coalesce(col_of(c).cast("string"), F.lit("\\N")) for c in row_key]
    return F.concat(F.lit(SURROGATE_PREFIX), F.md5(F.concat_ws("|", *parts)))


def cost_savings() -> Column:
    return F.coalesce(F.col("abc"), F.lit(0)) - F.coalesce(F.col("contract_cost"), F.lit(0))


def is_delayed() -> Column:
    """Actual completion day after the originally planned day; false when either is unknown."""
    late = tolerant_date(F.col("completion_date_actual")) > epoch_ms_date(F.col("completion_date_original"))
    return F.coalesce(late, F.lit(False))


def duration_days() -> Column:
    """Days from start to actual completion, negative when they are swapped; null unless both parse."""
    days = F.datediff(tolerant_date(F.col("completion_date_actual")), tolerant_date(F.col("start_date")))
    return days.cast("bigint")


def dedup_records(raw: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    return keep_latest(raw, RECORD_KEY, NEWEST_FIRST, tie_break)


def clean_records(records: DataFrame, row_key: list[str] | None = None) -> DataFrame:
    """The 26-column clean table, in its fixed column order."""
    row_key = row_key or records.columns
    key = F.coalesce(F.trim(F.col("project_id")), surrogate_key(row_key))

    def text(name: str) -> Column:
        return text_or(F.col(name), DEFAULTS[name]).alias(name)

    return records.select(
        key.alias("project_id"),
        text("contract_id"),
        text("region"),
        text("province"),
        text("municipality"),
        text("project_description"),
        text("type_of_work"),
        text("infra_type"),
        text("program"),
        number_or_zero(F.col("abc"), "double").alias("abc"),
        number_or_zero(F.col("contract_cost"), "double").alias("contract_cost"),
        cost_savings().cast("double").alias("cost_savings"),
        number_or_zero(F.col("infra_year"), "int").alias("infra_year"),
        number_or_zero(F.col("completion_year"), "int").alias("completion_year"),
        text("funding_year"),
        text("start_date"),
        text("completion_date_actual"),
        F.col("completion_date_original"),
        is_delayed().alias("is_delayed"),
        duration_days().alias("duration_days"),
        text("contractor"),
        text("implementing_office"),
        text("district_engineering_office"),
        text("legislative_district"),
        F.col("longitude").cast("double").alias("longitude"),
        F.col("latitude").cast("double").alias("latitude"),
    )


def with_cost(clean: DataFrame) -> DataFrame:
    """The rows every cost report is built on."""
    return clean.where(F.col("contract_cost") > 0)


def compact(clean: DataFrame) -> DataFrame:
    return with_cost(clean).select(*COMPACT_COLUMNS)
