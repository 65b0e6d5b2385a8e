"""One-row summaries of grouped totals, the numbers behind KPIs, insights and summaries.

Input is an already grouped table. Leaders and totals are plain aggregates
(`min_by` over an ordering), never a window over all groups, so the number of
groups may be large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of, group_key, numeric_of, total
from .order_statistics import order_statistics


def category_groups(df: DataFrame, category: str, measure: str) -> DataFrame:
    """(name, total, count) by trimmed category; a cell that is no number adds nothing but is counted."""
    keyed = df.select(group_key(col_of(category), null_words=False).alias("name"), numeric_of(df, measure).alias("v"))
    return keyed.where("name IS NOT NULL").groupBy("name").agg(total(F.col("v")).alias("total"), F.count("*").alias("count"))


def time_groups(df: DataFrame, time: str, measure: str) -> DataFrame:
    """(period, total, count) by trimmed time value."""
    return category_groups(df, time, measure).withColumnRenamed("name", "period")


def one_row(*parts: DataFrame) -> DataFrame:
    """Several one-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def group_facts(groups: DataFrame) -> DataFrame:
    """groups, total, mean, the top, the bottom and the top three. Ties go to the lesser name; the bottom is last in that order."""
    order = F.struct((-F.col("total")).alias("o"), F.col("name").alias("n"))
    item = F.struct("name", "total", "count")
    ends = groups.agg(
        F.count("*").alias("groups"),
        total(F.col("total").cast("decimal(38,6)")).alias("total"),
        F.min_by(item, order).alias("top"),
        F.max_by(item, order).alias("bottom"),
    ).select(
        "groups",
        "total",
        *[F.col(f"{end}.{part}").alias(f"{end}_{part}") for end in ("top", "bottom") for part in ("name", "total", "count")],
    )
    leaders = groups.orderBy(F.desc("total"), "name").limit(3)
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("total")).alias("o"), F.col("name").alias("name"))))
    top3 = leaders.agg(
        F.sum("total").alias("top3_total"),
        F.array_join(F.transform(ranked, lambda r: F.concat(F.lit('"'), r["name"], F.lit('"'))), ", ").alias("top3_names"),
    )
    return one_row(ends, top3).withColumn("mean", F.try_divide("total", "groups"))


def group_median(groups: DataFrame, count: int | None = None) -> float | None:
    """The total in the middle of the descending order (index k // 2)."""
    counts = None if count is None else {"total": count}
    return order_statistics(groups, {"total": F.col("total")}, {"median": lambda k: k - 1 - k // 2}, counts=counts)["total"]["median"]


def series_facts(series: DataFrame) -> DataFrame:
    """periods, first, last, the one before last, and the (earliest) peak of a time series."""
    item = F.struct("period", "total")
    peak_order = F.struct((-F.col("total")).alias("o"), F.col("period").alias("p"))
    ends = series.agg(
        F.count("*").alias("periods"),
        F.min_by(item, "period").alias("first"),
        F.max_by(item, "period").alias("last"),
        F.min_by(item, peak_order).alias("peak"),
    ).select("periods", *[F.col(f"{e}.{p}").alias(f"{e}_{p}") for e in ("first", "last", "peak") for p in ("period", "total")])
    recent = series.orderBy(F.desc("period")).limit(2)
    previous = recent.agg(F.count("*").alias("n"), F.min_by(item, "period").alias("p")).select(
        F.when(F.col("n") > 1, F.col("p.period")).alias("prev_period"), F.when(F.col("n") > 1, F.col("p.total")).alias("prev_total")
    )
    return one_row(ends, previous)
