"""KPIs, insights and summaries, each with the numbers that support it.

The first half selects numbers from one-row facts (see `facts` and
`reshape.period_sums`) as DataFrames. The second half words them: it takes the
collected facts, a handful of numbers however large the table is, and gives
rows of text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.labels import column_label, large_number, period_label, signed_percent, to_fixed
from . import wording as w
from .profile import Profile

# Thresholds, list lengths and confidence limits.
KPIS = 5
KPI_MEASURES = 2
INSIGHTS, WIDE_INSIGHTS = 10, 8
HIGH_ROWS, MEDIUM_ROWS = 30, 10
WIDE_HIGH_ROWS, WIDE_MEDIUM_ROWS = 20, 5
CONCENTRATION_GROUPS, CONCENTRATION_SHARE = 5, 50
SKEW_GROUPS, SKEW_FACTOR = 4, 3
BOTTOM_RATIO = 2
EXTREME_FACTOR = 5
LONG_SERIES = 5
SUMMARY_SKEW = 1.5

INSIGHT_SCHEMA = "position int, kind string, text string, type string, confidence string, evidence string"
KPI_SCHEMA = "position int, label string, value string, raw_value double"


def confidence(rows: int, high: int = HIGH_ROWS, medium: int = MEDIUM_ROWS) -> str:
    return "high" if rows >= high else "medium" if rows >= medium else "low"


def growth(new: Column, old: Column) -> Column:
    """Percent change; null when the old value is not positive."""
    return F.when(old > 0, (new - old) / old * 100)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(0.0)


# --- numbers: categories ------------------------------------------------------

def leader(facts: DataFrame) -> DataFrame:
    """Top group with its share of the total and its average per record."""
    return facts.where("groups >= 2").select(
        "groups", F.col("total").alias("total"), F.col("top_name").alias("name"), F.col("top_total").alias("value"), F.col("top_count").alias("records"),
        share(F.col("top_total"), F.col("total")).alias("share_pct"), F.try_divide("top_total", "top_count").alias("average"),
    )


def bottom(facts: DataFrame) -> DataFrame:
    """Bottom group, and how many times smaller it is when that is more than twice."""
    ratio = F.when(F.col("bottom_total") > 0, F.col("top_total") / F.col("bottom_total")).otherwise(0.0)
    return facts.where("groups >= 2").select(
        F.col("bottom_name").alias("name"), F.col("bottom_total").alias("value"), F.col("bottom_count").alias("records"),
        F.when(ratio > BOTTOM_RATIO, ratio).alias("times_less"),
    )


def concentration(facts: DataFrame) -> DataFrame:
    """The top three's share, and whether it is a risk."""
    pct = share(F.col("top3_total"), F.col("total"))
    return facts.where(F.col("groups") >= CONCENTRATION_GROUPS).select(
        "groups", "top3_total", "total", pct.alias("share_pct"), (pct > CONCENTRATION_SHARE).alias("high")
    )


def group_skew(facts: DataFrame, median: float | None) -> DataFrame:
    """Whether a few groups pull the mean up: top above three means, middle group below the mean."""
    middle = F.lit(median).cast("double")
    skewed = (F.col("top_total") > F.col("mean") * SKEW_FACTOR) & (middle < F.col("mean"))
    return facts.where(F.col("groups") >= SKEW_GROUPS).select("groups", "top_total", "mean", middle.alias("median"), skewed.alias("skewed"))


# --- numbers: time ------------------------------------------------------------

def overall_growth(series: DataFrame) -> DataFrame:
    """First against last period, when the first is positive."""
    pct = growth(F.col("last_total"), F.col("first_total"))
    return series.where("periods >= 2 AND first_total > 0").select(
        "periods", "first_period", "first_total", "last_period", "last_total", pct.alias("growth_pct"),
        F.when(F.col("periods") >= LONG_SERIES, "high").otherwise("medium").alias("confidence"),
    )


def momentum(series: DataFrame) -> DataFrame:
    """Last against previous period, when the previous is positive."""
    pct = growth(F.col("last_total"), F.col("prev_total"))
    return series.where("periods >= 2 AND prev_total > 0").select("prev_period", "prev_total", "last_period", "last_total", pct.alias("change_pct"))


def peak(series: DataFrame) -> DataFrame:
    """The peak period, unless it is the first or the last."""
    below = F.when(F.col("last_total") < F.col("peak_total"), (1 - F.col("last_total") / F.col("peak_total")) * 100)
    inner = (F.col("periods") >= 2) & (F.col("peak_period") != F.col("last_period")) & (F.col("peak_period") != F.col("first_period"))
    return series.where(inner).select("peak_period", "peak_total", "last_period", "last_total", below.alias("below_peak_pct"))


# --- numbers: extremes and wide tables ----------------------------------------

def extreme_range(numeric: DataFrame) -> DataFrame:
    """Numeric columns whose maximum is more than five times their mean."""
    wide = (F.col("mean") > 0) & (F.col("max") != 0) & (F.col("max") > F.col("mean") * EXTREME_FACTOR)
    return numeric.where(wide).withColumn("times_mean", F.col("max") / F.col("mean"))


def wide_facts(sums: DataFrame, periods: list[str]) -> DataFrame:
    """Latest, previous, first, average, peak and lowest period from one row of period sums."""
    last = len(periods) - 1
    labels = [period_label(F.lit(p)) for p in periods]
    high = F.array_max(F.array(*[F.struct(F.col(f"p{i}").alias("v"), F.lit(-i).alias("i"), labels[i].alias("label")) for i in range(last + 1)]))
    low = F.array_min(F.array(*[F.struct(F.col(f"p{i}").alias("v"), F.lit(i).alias("i"), labels[i].alias("label")) for i in range(last + 1)]))
    previous = F.col(f"p{last - 1}") if last else F.lit(None).cast("double")
    first, latest = F.col("p0"), F.col(f"p{last}")
    both = (first > 0) & (latest > 0) & F.lit(last >= 2)
    return sums.select(
        "rows", "grand_total", F.lit(len(periods)).alias("periods"),
        labels[0].alias("first_period"), first.alias("first_total"),
        labels[last].alias("latest_period"), latest.alias("latest_total"),
        (labels[last - 1] if last else F.lit(None).cast("string")).alias("prev_period"), previous.alias("prev_total"),
        (F.col("grand_total") / len(periods)).alias("period_average"),
        growth(latest, previous).alias("change_pct"),
        growth(latest, first).alias("growth_pct"),
        high["label"].alias("peak_period"), high["v"].alias("peak_total"),
        low["label"].alias("low_period"), low["v"].alias("low_total"),
        F.when(both, (F.pow(latest / first, F.lit(1.0 / max(last, 1))) - 1) * 100).alias("cagr_pct"),
    )


# --- wording: insights --------------------------------------------------------

@dataclass
class Insight:
    kind: str
    text: str
    type: str
    confidence: str | None = None
    evidence: str | None = None


def insight_table(spark, insights: list[Insight], limit: int = INSIGHTS) -> DataFrame:
    rows = [(i, x.kind, x.text, x.type, x.confidence, x.evidence) for i, x in enumerate(insights[:limit])]
    return spark.createDataFrame(rows, INSIGHT_SCHEMA)


def _pct(part: float, whole: float) -> float:
    return part / whole * 100 if whole > 0 else 0.0


def _change(new: float, old: float | None) -> float | None:
    return (new - old) / old * 100 if old is not None and old > 0 else None


def _tone(change: float) -> str:
    return "positive" if change >= 0 else "negative"


def category_insights(facts: Row, median: float | None, category: str, measure: str, rows: int) -> list[Insight]:
    """Leader, bottom, concentration and skew of a measure over the groups of a category."""
    n, total = facts["groups"], facts["total"]
    if n < 2:
        return []
    level = confidence(rows)
    names = {"what": column_label(measure).lower(), "groups": column_label(category).lower(), "n": n, "total": large_number(total)}
    top, low = facts["top_total"], facts["bottom_total"]
    text = w.LEADER.format(
        top=facts["top_name"], value=large_number(top), share=to_fixed(_pct(top, total), 0),
        average=large_number(top / facts["top_count"]), records=facts["top_count"], **names,
    )
    out = [Insight("leader", text, "positive", level, w.LEADER_EVIDENCE.format(measure=measure, category=category, rows=rows))]

    ratio = top / low if low > 0 else 0.0
    less = w.BOTTOM_LESS.format(times=to_fixed(ratio, 0)) if ratio > BOTTOM_RATIO else ""
    out.append(Insight("bottom", w.BOTTOM.format(low=facts["bottom_name"], value=large_number(low), records=facts["bottom_count"], less=less, **names), "info", level))

    held = _pct(facts["top3_total"], total)
    if n >= CONCENTRATION_GROUPS and held > CONCENTRATION_SHARE:
        text = w.CONCENTRATION.format(
            names=facts["top3_names"], share=to_fixed(held, 0), value=large_number(facts["top3_total"]), others=n - 3, rest=to_fixed(100 - held, 0), **names
        )
        out.append(Insight("concentration", text, "warning", level, w.CONCENTRATION_EVIDENCE.format(**names)))

    mean = total / n
    if n >= SKEW_GROUPS and median is not None and top > mean * SKEW_FACTOR and median < mean:
        text = w.SKEW.format(median=large_number(median), mean=large_number(mean), **names)
        out.append(Insight("skew", text, "warning", level, w.SKEW_EVIDENCE.format(**names)))
    return out


def time_insights(series: Row, time: str, measure: str, rows: int) -> list[Insight]:
    """Overall growth, momentum and peak of a measure over time."""
    n = series["periods"]
    if n < 2:
        return []
    level = confidence(rows)
    first, last, previous, peak_total = (series[k] for k in ("first_total", "last_total", "prev_total", "peak_total"))
    names = {"what": column_label(measure).lower(), "time": column_label(time).lower(), "n": n, "first": series["first_period"], "last": series["last_period"]}
    out = []
    overall = _change(last, first)
    if overall is not None:
        text = w.GROWTH.format(moved=_grew(overall), percent=to_fixed(abs(overall), 0), first_value=large_number(first), last_value=large_number(last), **names)
        out.append(Insight("growth", text, _tone(overall), "high" if n >= LONG_SERIES else "medium", w.GROWTH_EVIDENCE.format(**names)))
    recent = _change(last, previous)
    if recent is not None:
        text = w.MOMENTUM.format(value=large_number(last), percent=signed_percent(recent, 1), previous=series["prev_period"], previous_value=large_number(previous), **names)
        out.append(Insight("momentum", text, _tone(recent), level))
    if series["peak_period"] not in (names["first"], names["last"]):
        below = last < peak_total
        now = w.PEAK_BELOW.format(percent=to_fixed((1 - last / peak_total) * 100, 0)) if below else w.PEAK_HELD
        text = w.PEAK.format(peak=series["peak_period"], value=large_number(peak_total), now=now, **names)
        out.append(Insight("peak", text, "warning" if below else "positive", level))
    return out


def extreme_insights(profile: Profile) -> list[Insight]:
    """For the first two numeric columns: a maximum far above the mean."""
    out = []
    for c in profile.numeric[:2]:
        low, high, mean, median = (c.stats.get(k) or 0.0 for k in ("min", "max", "mean", "median"))
        if high and mean > 0 and high > mean * EXTREME_FACTOR:
            shown = {"low": large_number(low), "high": large_number(high), "mean": large_number(mean), "median": large_number(median)}
            text = w.EXTREME.format(label=c.label, times=to_fixed(high / mean, 0), **shown)
            level = "high" if profile.rows >= MEDIUM_ROWS else "medium"
            out.append(Insight("extreme_range", text, "warning", level, w.EXTREME_EVIDENCE.format(rows=profile.rows, **shown)))
    return out


def _wide_names(facts: Row) -> dict[str, object]:
    return {
        "rows": facts["rows"], "n": facts["periods"], "steps": facts["periods"] - 1, "first": facts["first_period"], "latest": facts["latest_period"],
        "first_value": large_number(facts["first_total"]), "latest_value": large_number(facts["latest_total"]),
    }


def wide_insights(facts: Row, groups: Row | None = None, category: str | None = None) -> list[Insight]:
    """Change, peak and lowest, CAGR, category rows, span."""
    names = _wide_names(facts)
    level = confidence(facts["rows"], WIDE_HIGH_ROWS, WIDE_MEDIUM_ROWS)
    change, cagr = facts["change_pct"], facts["cagr_pct"]
    out = []
    if change is not None:
        text = w.WIDE_GROWTH.format(previous=facts["prev_period"], percent=signed_percent(change, 1), previous_value=large_number(facts["prev_total"]), **names)
        out.append(Insight("wide_growth", text, _tone(change), level, w.WIDE_GROWTH_EVIDENCE.format(**names)))
    if facts["peak_period"] != facts["low_period"]:
        text = w.WIDE_PEAK_LOW.format(
            peak=facts["peak_period"], peak_value=large_number(facts["peak_total"]), low=facts["low_period"], low_value=large_number(facts["low_total"])
        )
        out.append(Insight("wide_peak_low", text, "info", level, w.WIDE_PEAK_LOW_EVIDENCE.format(**names)))
    if cagr is not None:
        text = w.CAGR.format(percent=signed_percent(cagr, 1), **names)
        out.append(Insight("cagr", text, _tone(cagr), "high" if facts["periods"] >= LONG_SERIES else "medium", w.CAGR_EVIDENCE.format(**names)))
    if groups is not None and category is not None and groups["groups"] >= 2:
        out += _wide_category_insights(groups, column_label(category).lower(), facts["latest_period"])
    out.append(Insight("wide_span", w.WIDE_SPAN.format(**names), "info"))
    return out


def _wide_category_insights(groups: Row, label: str, latest: str) -> list[Insight]:
    n, total = groups["groups"], groups["total"]
    level = "high" if n >= CONCENTRATION_GROUPS else "medium"
    names = {"n": n, "groups": label, "latest": latest}
    out = []
    if total > 0:
        text = w.WIDE_LEADER.format(top=groups["top_name"], value=large_number(groups["top_total"]), share=to_fixed(_pct(groups["top_total"], total), 0), **names)
        out.append(Insight("wide_leader", text, "positive", level, w.WIDE_LEADER_EVIDENCE.format(**names)))
    out.append(Insight("wide_bottom", w.WIDE_BOTTOM.format(low=groups["bottom_name"], value=large_number(groups["bottom_total"]), **names), "info", level))
    held = _pct(groups["top3_total"], total)
    if n >= CONCENTRATION_GROUPS and held > CONCENTRATION_SHARE:
        evidence = w.WIDE_CONCENTRATION_EVIDENCE.format(value=large_number(groups["top3_total"]), total=large_number(total))
        out.append(Insight("wide_concentration", w.WIDE_CONCENTRATION.format(share=to_fixed(held, 0), **names), "warning", "high", evidence))
    return out


# --- wording: KPIs ------------------------------------------------------------

def _kpi_table(spark, rows: list[tuple]) -> DataFrame:
    """KPI rows from (label, number, text); without a text the number's short form is shown."""
    data = [(i, label, text if text is not None else large_number(number), float(number)) for i, (label, number, text) in enumerate(rows[:KPIS])]
    return spark.createDataFrame(data, KPI_SCHEMA)


def standard_kpis(spark, profile: Profile) -> DataFrame:
    rows: list[tuple] = [(w.KPI_RECORDS, profile.rows, f"{profile.rows:,}")]
    main = profile.main_measures()[:KPI_MEASURES]
    rows += [(w.KPI_TOTAL.format(label=c.label), c.sum, None) for c in main]
    if main:
        rows.append((w.KPI_AVERAGE.format(label=main[0].label), main[0].stats["mean"], None))
    if profile.categorical:
        first = profile.categorical[0]
        rows.append((w.KPI_GROUPS.format(label=first.label), first.unique_count, f"{first.unique_count:,}"))
    if main and len(rows) < KPIS and main[0].stats["max"] and main[0].stats["max"] != main[0].sum:
        rows.append((w.KPI_HIGHEST.format(label=main[0].label), main[0].stats["max"], None))
    return _kpi_table(spark, rows)


def wide_kpis(spark, facts: Row, category: str | None = None, distinct: int | None = None) -> DataFrame:
    latest = facts["latest_period"]
    rows: list[tuple] = [
        (w.KPI_LATEST.format(latest=latest), facts["latest_total"], None),
        (w.KPI_GRAND_TOTAL, facts["grand_total"], None),
        (w.KPI_PERIOD_AVERAGE, facts["period_average"], None),
    ]
    if facts["change_pct"] is not None:
        rows.append((w.KPI_GROWTH.format(previous=facts["prev_period"], latest=latest), facts["change_pct"], signed_percent(facts["change_pct"], 1)))
    if category is not None and distinct is not None:
        rows.append((w.KPI_DISTINCT.format(label=column_label(category)), distinct, f"{distinct:,}"))
    return _kpi_table(spark, rows)


# --- wording: summaries -------------------------------------------------------

def _grew(change: float) -> str:
    return w.GREW if change >= 0 else w.DECLINED


def standard_summary(profile: Profile, span: Row | None = None, groups: Row | None = None, series: Row | None = None) -> str:
    """Scope, main measure, category leader, change over time.

    `groups` and `series` are facts of the main measure; `span` is any series'
    facts, for the count of periods and the first and last.
    """
    category = profile.categorical[0] if profile.categorical else None
    main = profile.main_measures()[0] if profile.main_measures() else None
    scope = []
    if category:
        scope.append(w.SCOPE_GROUPS.format(n=category.unique_count, groups=category.label.lower()))
    if span is not None and span["periods"] >= 2:
        scope.append(w.SCOPE_PERIODS.format(n=span["periods"], time=profile.temporal[0].label.lower(), first=span["first_period"], last=span["last_period"]))
    spanning = w.SCOPE_SPANNING.format(parts=" and ".join(scope)) if scope else ""
    parts = [w.SCOPE.format(rows=f"{profile.rows:,}", spanning=spanning)]
    if main is None:
        return parts[0]

    what, s = main.label.lower(), main.stats
    shown = {k: large_number(s[v]) for k, v in (("total", "sum"), ("low", "min"), ("high", "max"), ("mean", "mean"), ("median", "median"))}
    parts.append(w.MAIN.format(what=what, **shown))
    if s["mean"] and s["median"] and s["mean"] > s["median"] * SUMMARY_SKEW:
        parts.append(w.MAIN_SKEWED)
    if category and groups is not None and len(category.top) >= 2 and groups["groups"] >= 2:
        held = to_fixed(_pct(groups["top_total"], groups["total"]), 0)
        parts.append(
            w.MAIN_LEADER.format(n=category.unique_count, groups=category.label.lower(), top=groups["top_name"], value=large_number(groups["top_total"]), what=what, share=held)
        )
    change = _change(series["last_total"], series["first_total"]) if series is not None and series["periods"] >= 2 else None
    if change is not None:
        parts.append(
            w.MAIN_CHANGE.format(
                first=series["first_period"], last=series["last_period"], what=what, moved=_grew(change), percent=to_fixed(abs(change), 0),
                first_value=large_number(series["first_total"]), last_value=large_number(series["last_total"]),
            )
        )
    return " ".join(parts)


def wide_summary(facts: Row, groups: Row | None = None, category: str | None = None) -> str:
    """Scope, totals, growth, last change, category leader of a wide table."""
    names, average = _wide_names(facts), facts["period_average"]
    against = w.WIDE_AGAINST.format(percent=signed_percent((facts["latest_total"] / average - 1) * 100, 0)) if average > 0 else ""
    parts = [
        w.WIDE_SCOPE.format(**names),
        w.WIDE_TOTALS.format(total=large_number(facts["grand_total"]), average=large_number(average), value=names["latest_value"], against=against, **names),
    ]
    if facts["growth_pct"] is not None:
        parts.append(w.WIDE_CHANGE.format(moved=_grew(facts["growth_pct"]), percent=to_fixed(abs(facts["growth_pct"]), 0), **names))
    if facts["change_pct"] is not None:
        parts.append(w.WIDE_LAST_CHANGE.format(percent=signed_percent(facts["change_pct"], 1)))
    if groups is not None and category is not None and groups["groups"] >= 2:
        held = to_fixed(_pct(groups["top_total"], groups["total"]), 0)
        parts.append(
            w.WIDE_SUMMARY_LEADER.format(n=groups["groups"], groups=column_label(category).lower(), top=groups["top_name"], value=large_number(groups["top_total"]), share=held)
        )
    return " ".join(parts)
