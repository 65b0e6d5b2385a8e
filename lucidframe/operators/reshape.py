"""Wide tables: one column per period. Detection, unpivot, totals, categories over time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col_of, group_key, js_number, missing_of, numeric_of, total
from ..functions.labels import period_label
from .profile import as_text

# What a period column is called, when a table is wide, what a category column is, report sizes.
PERIOD_COLUMN = r"\d{4}(\s+\d+)?"
PERIOD_YEARS = range(1900, 2100)
LEAST_PERIODS = 3
WIDE_SHARE = 0.4
NUMERIC_SHARE = 0.5
LEAST_LENGTH = 3
LATEST_GROUPS = 15
SERIES = 5


def period_columns(columns: list[str]) -> list[str]:
    """The period columns, oldest first. '2018 9' comes before '2018 31': parts compare as numbers."""
    found = [c for c in columns if re.fullmatch(PERIOD_COLUMN, c.strip()) and int(c.strip()[:4]) in PERIOD_YEARS]
    return sorted(found, key=lambda c: [int(part) for part in c.split()])


def is_wide(columns: list[str]) -> bool:
    periods = period_columns(columns)
    return len(periods) >= LEAST_PERIODS and len(periods) > WIDE_SHARE * len(columns)


def category_facts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(position, column, filled, numeric, mean_length, is_category) for each column that is not a period."""
    periods = set(period_columns(df.columns))
    columns = [c for c in (columns or df.columns) if c not in periods]
    aggregates = []
    for i, c in enumerate(columns):
        text = F.when(~missing_of(df, c), as_text(df, c))
        number = text if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)) else js_number(text)
        aggregates += [F.count(text).alias(f"f{i}"), F.count(number).alias(f"n{i}"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias(f"l{i}")]
    rows = [
        F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col(f"n{i}").alias("numeric"),
            F.try_divide(F.col(f"l{i}"), F.col(f"f{i}")).alias("mean_length"),
        )
        for i, c in enumerate(columns)
    ]
    facts = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    category = (F.col("filled") > 0) & (F.col("numeric") <= F.col("filled") * NUMERIC_SHARE) & (F.col("mean_length") >= LEAST_LENGTH)
    return facts.withColumn("is_category", F.coalesce(category, F.lit(False)))


def category_columns(df: DataFrame) -> list[str]:
    return [r["column"] for r in category_facts(df).where("is_category").orderBy("position").collect()]


def unpivot_periods(df: DataFrame, ids: list[str] | None = None, periods: list[str] | None = None) -> DataFrame:
    """(ids…, period, value), one row per filled period cell. Zeros and cells that are not numbers are left out.

    Expand and filter only: no shuffle, at any size.
    """
    periods = periods or period_columns(df.columns)
    ids = [c for c in df.columns if c not in periods] if ids is None else ids
    # One value type for all periods: decimals stay exact where every period column has the same type.
    same = len({df.schema[p].dataType.simpleString() for p in periods}) == 1
    values = [numeric_of(df, p) if same else numeric_of(df, p).cast("double") for p in periods]
    numbers = df.select(*[col_of(c) for c in ids], *[v.alias(p) for p, v in zip(periods, values)])
    long = numbers.unpivot([col_of(c) for c in ids], [col_of(p) for p in periods], "period", "value")
    return long.where(F.col("value") != 0).withColumn("period", F.trim("period"))


def _value(df: DataFrame, period: str) -> Column:
    return F.coalesce(numeric_of(df, period), F.lit(0))


def period_sums(df: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """One row: `rows`, `grand_total`, and the total of each period as p0, p1, … oldest first."""
    periods = periods or period_columns(df.columns)
    row_sum = sum((_value(df, p) for p in periods[1:]), _value(df, periods[0]))
    return df.agg(
        F.count("*").alias("rows"),
        total(row_sum).alias("grand_total"),
        *[total(numeric_of(df, p)).alias(f"p{i}") for i, p in enumerate(periods)],
    )


def period_totals(df: DataFrame, periods: list[str] | None = None) -> DataFrame:
    """(position, period, total), oldest first."""
    periods = periods or period_columns(df.columns)
    rows = [
        F.struct(F.lit(i).alias("position"), period_label(F.lit(p)).alias("period"), F.col(f"p{i}").alias("total"))
        for i, p in enumerate(periods)
    ]
    return period_sums(df, periods).select(F.inline(F.array(*rows)))


def category_totals(df: DataFrame, category: str, period: str) -> DataFrame:
    """(name, total, count) of one period by category."""
    keyed = df.select(group_key(col_of(category), null_words=False).alias("name"), _value(df, period).alias("v"))
    return keyed.where("name IS NOT NULL").groupBy("name").agg(total(F.col("v")).alias("total"), F.count("*").alias("count"))


def period_by_category(df: DataFrame, category: str, period: str | None = None, k: int = LATEST_GROUPS) -> DataFrame:
    """(name, value): the largest categories of a period, the latest by default."""
    period = period or period_columns(df.columns)[-1]
    groups = category_totals(df, category, period).where(F.col("total") != 0)
    return groups.orderBy(F.desc("total"), "name").limit(k).select("name", F.col("total").alias("value"))


def top_categories(df: DataFrame, category: str, k: int = SERIES) -> list[str]:
    latest = period_columns(df.columns)[-1]
    return [r["name"] for r in category_totals(df, category, latest).orderBy(F.desc("total"), "name").limit(k).collect()]


def multi_series(df: DataFrame, category: str, k: int = SERIES) -> DataFrame:
    """(position, period, series, value): every period of the k categories that lead the latest one.

    A category's rows are added up. All categories' periods come from one
    group-by; the k leaders are picked from its result.
    """
    periods = period_columns(df.columns)
    name = group_key(col_of(category), null_words=False)
    sums = (
        df.withColumn("series", name)
        .where(F.col("series").isNotNull())
        .groupBy("series")
        .agg(*[total(numeric_of(df, p)).alias(f"p{i}") for i, p in enumerate(periods)])
        .orderBy(F.desc(f"p{len(periods) - 1}"), "series")
        .limit(k)
    )
    rows = [
        F.struct(F.lit(i).alias("position"), F.trim(F.lit(p)).alias("period"), F.col("series"), F.col(f"p{i}").alias("value"))
        for i, p in enumerate(periods)
    ]
    return sums.select(F.inline(F.array(*rows)))


def multi_series_pivot(df: DataFrame, category: str, k: int = SERIES) -> DataFrame:
    """The same as a chart table: one row per period, one column per leading category."""
    names = top_categories(df, category, k)
    return multi_series(df, category, k).groupBy("position", "period").pivot("series", names).sum("value").orderBy("position").drop("position")
