"""Chart data: grouped sums, time series, shares, record counts, scatter points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of, group_key, is_missing, numeric_of, total
from ..functions.labels import column_label
from . import profile as prof
from . import reshape
from . import wording as w

# Chart limits and the wording of correlation strength.
GROUPS = 30
BARS = 15
WIDE_BAR_FROM = 8
PIE_GROUPS = 10
PIE_RECORDS = 8
WIDE_PIE_GROUPS = 12
SCATTER_POINTS = 200
LEAST_POINTS = 10
TIME_MEASURES = 3
GOOD_CATEGORY = (2, 30)
ANY_CATEGORY = (2, 100)
LEAST_TIME_SHARE = 0.3
STRONG, MODERATE = 0.7, 0.4


def group_sums(df: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """(key, measure…): sums per trimmed key. A cell that is no number adds nothing."""
    keyed = df.select(group_key(col_of(key)).alias("_key"), *[numeric_of(df, m).alias(m) for m in measures])
    sums = keyed.where("_key IS NOT NULL").groupBy("_key").agg(*[total(col_of(m)).alias(m) for m in measures])
    return sums.withColumnRenamed("_key", key)


def largest_groups(df: DataFrame, key: str, measures: list[str], k: int = GROUPS) -> DataFrame:
    """The k groups with the largest first measure; ties by key."""
    return group_sums(df, key, measures).orderBy(col_of(measures[0]).desc(), col_of(key)).limit(k)


def time_series(df: DataFrame, time: str, measures: list[str], k: int | None = None) -> DataFrame:
    """Sums per period in time order; with k, the first k periods."""
    ordered = group_sums(df, time, measures).orderBy(col_of(time))
    return ordered if k is None else ordered.limit(k)


def shares(groups: DataFrame, name: str, value: str, of: DataFrame | None = None) -> DataFrame:
    """(name, value, share): each group's part of the total of `of`, by default of the groups themselves.

    Hand in all groups as `of` where `groups` are the largest ones only.
    """
    whole = (groups if of is None else of).agg(F.sum(col_of(value)).alias("t")).select("t")
    return groups.select(
        col_of(name).alias("name"), col_of(value).alias("value"), F.try_divide(col_of(value), whole.scalar()).alias("share")
    )


def record_counts(df: DataFrame, category: str, k: int) -> DataFrame:
    """(name, value): the k most frequent values by record count."""
    return prof.top_values(df, [category], k).select(F.col("value").alias("name"), F.col("count").alias("value"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    numbers = df.select("*", numeric_of(df, x).cast("double").alias("_x"), numeric_of(df, y).cast("double").alias("_y"))
    return numbers.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def scatter_points(df: DataFrame, x: str, y: str, order_by: list[str], k: int = SCATTER_POINTS) -> DataFrame:
    """(x, y): the first k complete pairs in row order."""
    ordered = _pairs(df, x, y).orderBy(*[col_of(c).asc_nulls_last() for c in order_by], "_x", "_y").limit(k)
    return ordered.select(F.col("_x").alias("x"), F.col("_y").alias("y"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: pairs, r over all rows (0 when a column does not vary), and its strength and direction in words."""
    # `corr` itself fails on a column that does not vary.
    r = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    named = _pairs(df, x, y).agg(F.count("*").alias("pairs"), F.coalesce(r, F.lit(0.0)).alias("r"))
    size = F.abs("r")
    return named.withColumns(
        {
            "strength": F.when(size > STRONG, "strong").when(size > MODERATE, "moderate").otherwise("weak"),
            "direction": F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("no"),
        }
    )


# --- which charts suit a table ------------------------------------------------

@dataclass
class Chart:
    kind: str
    title: str
    x: str
    y: list[str]
    data: DataFrame
    description: str = ""


def _low(column: prof.ColumnProfile) -> str:
    return column.label.lower()


def _pair_text(df: DataFrame, x: prof.ColumnProfile, y: prof.ColumnProfile) -> str:
    found = pearson(df, x.name, y.name).first()
    tend = w.TEXT_TOGETHER if found["r"] > 0 else w.TEXT_OPPOSED
    return w.TEXT_PAIR.format(strength=found["strength"], direction=found["direction"], r=f"{found['r']:.2f}", x=x.label, y=y.label, tend=tend)


def _bar_kind(groups: int) -> str:
    return "horizontal-bar" if groups > WIDE_BAR_FROM else "bar"


def _bar_rows(kind: str) -> int:
    return BARS if kind == "horizontal-bar" else GROUPS


def _between(columns: list[prof.ColumnProfile], limits: tuple[int, int]) -> list[prof.ColumnProfile]:
    return [c for c in columns if limits[0] <= c.unique_count <= limits[1]]


def _chart_counts(df: DataFrame, keys: list[str], time: str | None, pair: tuple[str, str] | None) -> dict[str, int]:
    """What decides about charts, in one job: distinct groups per key, rows with a time, complete pairs."""
    counts = {f"groups:{c}": F.countDistinct(group_key(col_of(c))) for c in dict.fromkeys(keys)}
    if time:
        counts["timed"] = F.count_if(~is_missing(col_of(time), "blank"))
    if pair:
        counts["pairs"] = F.count_if(numeric_of(df, pair[0]).isNotNull() & numeric_of(df, pair[1]).isNotNull())
    if not counts:
        return {}
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())]).first()
    return dict(zip(counts, row))


def recommend_charts(df: DataFrame, profile: prof.Profile, order_by: list[str] | None = None) -> list[Chart]:
    """The charts a standard table supports, in display order. Chart data stays lazy."""
    numbers, categories, times = profile.numeric, profile.categorical, profile.temporal
    good, wider = _between(categories, GOOD_CATEGORY), _between(categories, ANY_CATEGORY)
    time = times[0] if times else None
    keys = [c.name for c in ([time] if time else []) + good[:2] + wider[:1]]
    pair = (numbers[0].name, numbers[1].name) if len(numbers) > 1 else None
    counts = _chart_counts(df, keys, time.name if time else None, pair)
    groups = {k: counts[f"groups:{k}"] for k in keys}
    charts: list[Chart] = []

    timed = bool(time and numbers) and groups[time.name] > 1 and counts["timed"] >= profile.rows * LEAST_TIME_SHARE
    if timed:
        measures = [c.name for c in numbers[:TIME_MEASURES]]
        charts.append(Chart("line", w.CHART_OVER_TIME.format(measure=numbers[0].label, time=time.label), time.name, measures, time_series(df, time.name, measures),
                            w.TEXT_OVER_TIME.format(measure=_low(numbers[0]), n=groups[time.name], time=_low(time))))

    if good and numbers and groups[good[0].name] >= 2:
        category, measure, n = good[0], numbers[0], groups[good[0].name]
        kind = _bar_kind(n)
        charts.append(
            Chart(kind, w.CHART_BY.format(measure=measure.label, category=category.label), category.name, [measure.name], largest_groups(df, category.name, [measure.name], _bar_rows(kind)),
                  w.TEXT_BY.format(measure=_low(measure), category=_low(category)))
        )
        if n <= PIE_GROUPS:
            data = shares(largest_groups(df, category.name, [measure.name]), category.name, measure.name, group_sums(df, category.name, [measure.name]))
            charts.append(Chart("pie", w.CHART_SHARE.format(measure=measure.label, category=category.label), category.name, [measure.name], data, w.TEXT_SHARE.format(measure=_low(measure), category=_low(category))))
        elif len(category.top) >= 2:
            charts.append(Chart("pie", w.CHART_RECORD_SHARE.format(category=category.label), "name", ["value"], record_counts(df, category.name, PIE_RECORDS), w.TEXT_RECORD_SHARE.format(category=_low(category))))

    if len(good) > 1 and numbers and groups[good[1].name] >= 2:
        category, measure = good[1], numbers[min(1, len(numbers) - 1)]
        kind = _bar_kind(groups[category.name])
        charts.append(
            Chart(kind, w.CHART_BY.format(measure=measure.label, category=category.label), category.name, [measure.name], largest_groups(df, category.name, [measure.name], _bar_rows(kind)), w.TEXT_SECOND.format(category=_low(category)))
        )

    if timed and len(numbers) > 1:
        measure = numbers[1]
        charts.append(Chart("area", w.CHART_TREND.format(measure=measure.label), time.name, [measure.name], time_series(df, time.name, [measure.name]), w.TEXT_TREND.format(measure=_low(measure))))

    if pair and counts["pairs"] > LEAST_POINTS:
        x, y = numbers[0], numbers[1]
        charts.append(Chart("scatter", w.CHART_PAIR.format(x=x.label, y=y.label), x.name, [y.name], scatter_points(df, x.name, y.name, order_by or []), _pair_text(df, x, y)))

    if wider and len(numbers) > 1 and len(charts) < 4 and groups[wider[0].name] >= 2:
        category, measure = wider[0], numbers[1]
        data = largest_groups(df, category.name, [measure.name], BARS)
        text = w.TEXT_WIDER.format(measure=measure.label, category=_low(category))
        charts.append(Chart("horizontal-bar", w.CHART_BY.format(measure=measure.label, category=category.label), category.name, [measure.name], data, text))

    if not charts and categories and len(categories[0].top) >= 2:
        category = categories[0]
        n = len(category.top)
        charts.append(Chart(_bar_kind(n), w.CHART_RECORDS.format(category=category.label), "name", ["value"], record_counts(df, category.name, BARS), w.TEXT_RECORDS.format(category=_low(category))))
        if n <= PIE_GROUPS:
            charts.append(Chart("pie", w.CHART_DISTRIBUTION.format(category=category.label), "name", ["value"], record_counts(df, category.name, prof.TOP_VALUES), w.TEXT_DISTRIBUTION))
    return charts


def recommend_wide_charts(df: DataFrame, periods: list[str], categories: list[str]) -> list[Chart]:
    """The charts a wide table supports."""
    totals = reshape.period_totals(df, periods).orderBy("position").select("period", "total")
    whole = w.TEXT_TOTALS.format(n=len(periods), first=periods[0].strip(), last=periods[-1].strip())
    charts = [Chart("line", w.CHART_TOTAL_OVER_TIME, "period", ["total"], totals, whole), Chart("area", w.CHART_VOLUME, "period", ["total"], totals, w.TEXT_VOLUME)]
    latest = periods[-1]
    for place, category in enumerate(categories[:2]):
        label = column_label(category)
        named = {"category": label.lower()}
        data = reshape.period_by_category(df, category, latest)
        n = data.count()
        if n >= 2:
            charts.append(Chart(_bar_kind(n), w.CHART_PERIOD_BY.format(period=latest.strip(), category=label), category, ["value"], data, (w.TEXT_PERIOD_SECOND if place else w.TEXT_PERIOD_BY).format(**named)))
        if place == 0:
            if 2 <= n <= WIDE_PIE_GROUPS:
                charts.append(Chart("pie", w.CHART_PERIOD_SHARE.format(period=latest.strip()), category, ["value"], shares(data, "name", "value"), w.TEXT_PERIOD_SHARE.format(period=latest.strip(), **named)))
            leaders = reshape.top_categories(df, category)
            if len(leaders) >= 2:
                charts.append(Chart("line", w.CHART_LEADERS.format(category=label), "period", leaders, reshape.multi_series(df, category), w.TEXT_LEADERS.format(n=len(leaders), **named)))
    return charts


def chart_table(df: DataFrame, charts: list[Chart]) -> DataFrame:
    """(position, kind, title, x, y): the recommendations as rows."""
    rows = [(i, c.kind, c.title, c.x, ", ".join(c.y)) for i, c in enumerate(charts)]
    return df.sparkSession.createDataFrame(rows, "position int, kind string, title string, x string, y string")
