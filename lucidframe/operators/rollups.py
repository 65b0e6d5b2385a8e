"""Fixed reports over the clean project table.

Each is one group-by with map-side partial aggregation; ranked ones end in a
top-k instead of a full sort. Money is added as decimals, so totals do not
depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import money_total
from .records import DEFAULTS, with_cost

# Report sizes.
TOP_PROVINCES = 20
TOP_CONTRACTORS = 15


def _count() -> Column:
    return F.count("*").alias("project_count")


def _cost() -> Column:
    return money_total(F.col("contract_cost")).alias("total_cost")


def _average() -> Column:
    return (money_total(F.col("contract_cost")) / F.count("contract_cost")).alias("avg_cost")


def _delayed() -> Column:
    return F.count_if(F.col("is_delayed")).alias("delayed_count")


def _ranked(*ties: str) -> list[Column]:
    return [F.desc("total_cost"), *[F.asc(t) for t in ties]]


def project_summary(clean: DataFrame) -> DataFrame:
    return with_cost(clean).agg(
        F.count("*").alias("total_projects"),
        F.countDistinct("region").alias("total_regions"),
        F.countDistinct("province").alias("total_provinces"),
        F.countDistinct("municipality").alias("total_municipalities"),
        money_total(F.col("contract_cost")).alias("total_contract_cost"),
        money_total(F.col("abc")).alias("total_abc"),
        (money_total(F.col("contract_cost")) / F.count("contract_cost")).alias("avg_cost"),
        money_total(F.col("cost_savings")).alias("total_savings"),
        F.count_if(F.col("is_delayed")).alias("delayed_projects"),
        F.avg("duration_days").alias("avg_duration_days"),
    )


def by_region(clean: DataFrame) -> DataFrame:
    return with_cost(clean).groupBy("region").agg(_count(), _cost(), _average(), _delayed()).orderBy(*_ranked("region"))


def by_type_of_work(clean: DataFrame) -> DataFrame:
    return with_cost(clean).groupBy("type_of_work").agg(_count(), _cost(), _average()).orderBy(*_ranked("type_of_work"))


def by_funding_year(clean: DataFrame) -> DataFrame:
    return (
        with_cost(clean)
        .where(F.col("funding_year") != "")
        .groupBy("funding_year")
        .agg(_count(), _cost(), money_total(F.col("cost_savings")).alias("savings"))
        .orderBy("funding_year")
    )


def top_provinces(clean: DataFrame, k: int = TOP_PROVINCES) -> DataFrame:
    grouped = with_cost(clean).groupBy("province", "region").agg(_count(), _cost())
    return grouped.orderBy(*_ranked("province", "region")).limit(k)


def top_contractors(clean: DataFrame, k: int = TOP_CONTRACTORS) -> DataFrame:
    known = with_cost(clean).where(F.col("contractor") != DEFAULTS["contractor"])
    return known.groupBy("contractor").agg(_count(), _cost()).orderBy(*_ranked("contractor")).limit(k)


def distinct_regions(clean: DataFrame) -> DataFrame:
    return with_cost(clean).select("region").distinct().orderBy("region")


def distinct_years(clean: DataFrame) -> DataFrame:
    """Not limited to rows with a cost, unlike every other report."""
    return clean.where(F.col("funding_year") != "").select("funding_year").distinct().orderBy("funding_year")


def drill_region(clean: DataFrame) -> DataFrame:
    """All regions' province reports at once; split by region when written."""
    return with_cost(clean).groupBy("region", "province").agg(_count(), _cost())


def drill_year(clean: DataFrame) -> DataFrame:
    dated = with_cost(clean).where(F.col("funding_year") != "")
    return dated.groupBy("funding_year", "region").agg(_count(), _cost(), _delayed())


def all_reports(clean: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": project_summary(clean),
        "by_region": by_region(clean),
        "by_type_of_work": by_type_of_work(clean),
        "by_funding_year": by_funding_year(clean),
        "by_province": top_provinces(clean),
        "top_contractors": top_contractors(clean),
        "regions": distinct_regions(clean),
        "years": distinct_years(clean),
    }
