"""Counts that describe a table before and after cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of

# The columns the raw audit and the post-clean check look at.
AUDITED = {
    "region": "region_nulls",
    "province": "province_nulls",
    "contract_cost": "cost_nulls",
    "contractor": "contractor_nulls",
    "type_of_work": "type_nulls",
}
CORE_FIELDS = ("region", "province", "project_description", "type_of_work", "contractor")


def null_counts(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """One row: total rows and the null count of each column, in one scan."""
    columns = columns or AUDITED
    return df.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(col_of(c).isNull()).alias(name) for c, name in columns.items()],
    )


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat a key that another row already has."""
    per_key = df.groupBy(*[col_of(k) for k in keys]).agg(F.count("*").alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def validate_no_nulls(df: DataFrame, columns: tuple[str, ...] = CORE_FIELDS) -> DataFrame:
    """One row: null count per column and PASS or WARN. It reports; it never stops a job."""
    counted = df.agg(*[F.count_if(col_of(c).isNull()).alias(f"{c}_nulls") for c in columns])
    clean = reduce(lambda a, b: a & b, [F.col(f"{c}_nulls") == 0 for c in columns])
    return counted.withColumn("passed", clean).withColumn("status", F.when(clean, "PASS").otherwise("WARN"))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """One row per named stage with its row count."""
    counted = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("stage"), "row_count")
        for name, df in stages.items()
    ]
    return reduce(DataFrame.unionAll, counted)
