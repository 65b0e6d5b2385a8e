"""Analysis of any table: profile, KPIs, charts, insights, summary, filters.

The profile (one small record per column) and one-row facts reach the driver and
decide which aggregates to plan. The data does not: charts, profiles and filters
are aggregates, and the grouped table behind the insights is persisted while two
of them read it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col_of
from ..functions.labels import column_label, dataset_title
from ..operators import charts as ch
from ..operators import facts as fx
from ..operators import insights as ins
from ..operators import profile as prof
from ..operators import reshape as rs
from ..operators.wording import NO_DATA


@dataclass
class Analysis:
    name: str
    total_rows: int
    total_columns: int
    is_wide: bool
    profile: prof.Profile
    kpis: DataFrame
    charts: list[ch.Chart]
    insights: DataFrame
    summary: DataFrame
    filters: DataFrame
    context: str
    source: DataFrame
    approximate: bool = False
    helpers: tuple[str, ...] = ()
    _held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Drop the shared grouped tables from the executors."""
        for df in self._held:
            df.unpersist()


def analyze(df: DataFrame, name: str, order_by: list[str] | None = None, approximate: bool = False, helpers: tuple[str, ...] = ()) -> Analysis:
    """Analyze a table; one with enough period columns is treated as wide.

    `order_by` fixes which rows are the first. Columns named in `helpers` are there to order rows or to join, and are not
    analyzed; all others are, whatever their names.
    """
    title = dataset_title(name)
    if df.isEmpty():
        return _empty(df, title)
    out = _analyze_wide(df, title, approximate) if rs.is_wide(df.columns) else _analyze_standard(df, title, order_by, approximate, helpers)
    return replace(out, approximate=approximate, helpers=helpers)


def refine(analysis: Analysis, selected: dict[str, str], order_by: list[str] | None = None) -> Analysis:
    """The analysis of the rows whose cells equal the selected texts; the given one when no row does."""
    rows = filter_rows(analysis.source, selected)
    return analysis if rows.isEmpty() else analyze(rows, analysis.name, order_by, analysis.approximate, analysis.helpers)


def analyze_selected(df: DataFrame, name: str, selected: dict[str, str], order_by: list[str] | None = None, approximate: bool = False, helpers: tuple[str, ...] = ()) -> Analysis:
    """What `refine` makes of a table's analysis, without making that first: of all rows only when none is selected."""
    rows = filter_rows(df, selected)
    return analyze(df if rows.isEmpty() else rows, name, order_by, approximate, helpers)


def filter_rows(df: DataFrame, selected: dict[str, str]) -> DataFrame:
    for column, value in selected.items():
        if value:
            df = df.where(_equals(df, column, value))
    return df


def _equals(df: DataFrame, column: str, value: str) -> Column:
    """A cell whose text is `value`; whole numbers are compared as numbers, which readers can push down."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.IntegralType) and re.fullmatch(r"0|-?[1-9]\d{0,17}", value):
        return col_of(column) == F.lit(int(value)).cast("bigint")
    return prof.as_text(df, column) == F.lit(value)


def _empty(df: DataFrame, title: str) -> Analysis:
    spark = df.sparkSession
    return Analysis(
        title, 0, len(df.columns), False, prof.Profile(0, []), spark.createDataFrame([], ins.KPI_SCHEMA), [], spark.createDataFrame([], ins.INSIGHT_SCHEMA),
        spark.createDataFrame([(NO_DATA,)], "summary string"), spark.createDataFrame([], "column string, label string, value string, count bigint"), "", df,
    )


def _analyze_standard(df: DataFrame, title: str, order_by: list[str] | None, approximate: bool, helpers: tuple[str, ...]) -> Analysis:
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in helpers]
    profile = prof.profile(df, columns, approximate, order_by)
    numbers, categories, times = profile.numeric, profile.categorical, profile.temporal
    first = numbers[0].name if numbers else None
    main = profile.main_measures()[0].name if profile.main_measures() else None
    held: list[DataFrame] = []

    # Facts of the first measure feed the insights, those of the main one the summary; often they coincide.
    group_facts: dict[str, Row] = {}
    series_facts: dict[str, Row] = {}
    median = None
    for measure in dict.fromkeys(m for m in (first, main) if m):
        if categories:
            groups = fx.category_groups(df, categories[0].name, measure).persist()
            held.append(groups)
            group_facts[measure] = fx.group_facts(groups).first()
            if measure == first and group_facts[measure]["groups"] >= ins.SKEW_GROUPS:
                median = fx.group_median(groups, group_facts[measure]["groups"])
        if times:
            series_facts[measure] = fx.series_facts(fx.time_groups(df, times[0].name, measure)).first()

    found: list[ins.Insight] = []
    if first and categories:
        found += ins.category_insights(group_facts[first], median, categories[0].name, first, profile.rows)
    if first and times:
        found += ins.time_insights(series_facts[first], times[0].name, first, profile.rows)
    found += ins.extreme_insights(profile)

    span = next(iter(series_facts.values()), None)
    if times and span is None:
        span = fx.series_facts(fx.time_groups(df.withColumn("_one", F.lit(1)), times[0].name, "_one")).first()
    summary = ins.standard_summary(profile, span, group_facts.get(main), series_facts.get(main))
    return Analysis(
        title, profile.rows, len(columns), False, profile, ins.standard_kpis(spark, profile), ch.recommend_charts(df, profile, order_by),
        ins.insight_table(spark, found), spark.createDataFrame([(summary,)], "summary string"), filters_of(df, profile.categorical),
        prof.context_text(title, df.columns, profile), df, _held=held,
    )


def _analyze_wide(df: DataFrame, title: str, approximate: bool) -> Analysis:
    spark = df.sparkSession
    periods = rs.period_columns(df.columns)
    categories = rs.category_columns(df)
    profile = prof.profile(rs.unpivot_periods(df, categories, periods), ["period", "value", *categories], approximate)
    raw = prof.profile(df, categories, approximate) if categories else prof.Profile(profile.rows, [])
    facts = ins.wide_facts(rs.period_sums(df, periods), periods).first()
    category = categories[0] if categories else None
    groups = fx.group_facts(rs.category_totals(df, category, periods[-1])).first() if category else None
    shown = profile.categorical[0] if profile.categorical else None
    return Analysis(
        title, facts["rows"], len(df.columns), True, profile,
        ins.wide_kpis(spark, facts, shown.name if shown else None, shown.unique_count if shown else None),
        ch.recommend_wide_charts(df, periods, categories),
        ins.insight_table(spark, ins.wide_insights(facts, groups, category), ins.WIDE_INSIGHTS),
        spark.createDataFrame([(ins.wide_summary(facts, groups, category),)], "summary string"),
        filters_of(df, raw.categorical), prof.context_text(title, df.columns, profile), df,
    )


def filters_of(df: DataFrame, categories: list[prof.ColumnProfile]) -> DataFrame:
    """Filter options from profiles that are already there."""
    rows, shown = [], 0
    for c in categories:
        usable = prof.usable_values(c.top)
        if prof.FILTER_DISTINCT[0] <= c.unique_count <= prof.FILTER_DISTINCT[1] and len(usable) >= 2 and shown < prof.FILTER_COLUMNS:
            shown += 1
            rows += [(c.name, column_label(c.name), value, count) for value, count in usable]
    return df.sparkSession.createDataFrame(rows, "column string, label string, value string, count bigint")


__all__ = ["Analysis", "analyze", "analyze_selected", "filter_rows", "refine"]
