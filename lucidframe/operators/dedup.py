"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col_of


def keep_latest(df: DataFrame, keys: list[str], newest_first: list[str], tie_break: list[str] | None = None) -> DataFrame:
    """One row per key: the newest by the given columns (descending, nulls last).

    Rows whose keys are null form one group, like any other key. `row_number = 1`
    is planned with a group limit ahead of the shuffle, so each task sends at
    most one row per key and a key that holds a third of all rows costs no more
    than a rare one. Without `tie_break` the remaining columns decide, so the
    result is the same on every run.
    """
    if tie_break is None:
        tie_break = [c for c in df.columns if c not in keys and c not in newest_first]
    order: list[Column] = [col_of(c).desc_nulls_last() for c in newest_first]
    order += [col_of(c).asc_nulls_last() for c in tie_break]
    window = Window.partitionBy(*[col_of(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Whole-row duplicates. Values are compared as they are, before any trimming."""
    return df.dropDuplicates()
