"""Columns that say nothing new: duplicates of others, constant and nearly constant ones."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from .profile import _distinct_table

NEARLY = 0.95


def _text(name: str):
    return col_of(name).cast("string")


def duplicate_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, duplicate_of) of every pair of columns that hold the same text in every row, nulls included; the earlier one is the original.

    A column's fingerprint is the sum, over all rows, of a digest of its cell together with one of the whole row: it does not depend on
    the order of rows, and only columns alike row by row share one. One aggregate gives all fingerprints; a second one compares
    the few candidate pairs cell by cell.
    """
    columns = columns or df.columns
    cells = df.select(*(_text(c).alias(f"c{i}") for i, c in enumerate(columns)))
    row = F.xxhash64(*(F.coalesce(F.col(f"c{i}"), F.lit("\0")) for i in range(len(columns))))
    cells = cells.withColumn("row", row)
    sums = cells.agg(*(F.sum(F.xxhash64("row", F.coalesce(F.col(f"c{i}"), F.lit("\0"))).cast("decimal(38,0)")).alias(f"c{i}") for i in range(len(columns)))).first()
    alike = defaultdict(list)
    for i in range(len(columns)):
        alike[sums[i]].append(i)
    pairs = [(a, b) for group in alike.values() for a, b in combinations(group, 2)]
    found = []
    if pairs and sums[0] is not None:
        differ = cells.agg(*(F.count_if(~F.col(f"c{a}").eqNullSafe(F.col(f"c{b}"))) for a, b in pairs)).first()
        found = [(columns[b], columns[a]) for (a, b), n in zip(pairs, differ, strict=True) if n == 0]
    return df.sparkSession.createDataFrame(found, "column string, duplicate_of string")


def constant_columns(df: DataFrame, columns: list[str] | None = None, nearly: float = NEARLY) -> DataFrame:
    """(column, kind, share) of columns that are empty, constant, or nearly so: one value in at least the share `nearly` of all rows.

    Missing cells count as rows, so a column that is filled in half its rows with one value is none of these.
    """
    columns = columns or df.columns
    rows = df.count()
    common = _distinct_table(df, columns).groupBy("column").agg(F.max("count").alias("top"))
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").join(common, "column", "left")
    share = F.try_divide(F.col("top"), F.lit(rows))
    kind = F.when(F.col("top").isNull(), "empty").when(F.col("top") == rows, "constant").when(share >= nearly, "nearly constant")
    return named.select("column", kind.alias("kind"), F.coalesce(share, F.lit(0.0)).alias("share")).where("kind IS NOT NULL")
