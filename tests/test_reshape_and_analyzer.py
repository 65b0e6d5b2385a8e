from __future__ import annotations

import pytest

from lucidframe.operators import charts as ch
from lucidframe.operators import facts as fx
from lucidframe.operators import insights as ins
from lucidframe.operators import reshape as rs
from lucidframe.plans.analyzer import analyze, analyze_selected, refine


@pytest.fixture(scope="module")
def wide(spark):
    rows = [("North", "alpha", 100.0, 0.0, "121"), ("South", "beta", None, 5.0, "x"), ("North", "gamma", 1.0, 2.0, "3"), (" ", "delta", 7.0, 7.0, "7")]
    return spark.createDataFrame(rows, "region string, name string, `2019` double, `2020` double, `2021` string")


def test_period_columns_in_number_order():
    assert rs.period_columns(["2018 31", "a", "2018 9", "2017", "1800", "20", "2100"]) == ["2017", "2018 9", "2018 31"]
    assert rs.is_wide(["a", "2019", "2020", "2021"]) and not rs.is_wide(["a", "b", "c", "d", "e", "2019", "2020", "2021"])


def test_unpivot_drops_zero_null_and_text(wide, rows_of):
    got = rows_of(rs.unpivot_periods(wide, ["name"]))
    assert got == sorted(
        [("alpha", "2019", 100.0), ("alpha", "2021", 121.0), ("beta", "2020", 5.0), ("gamma", "2019", 1.0), ("gamma", "2020", 2.0),
         ("gamma", "2021", 3.0), ("delta", "2019", 7.0), ("delta", "2020", 7.0), ("delta", "2021", 7.0)], key=repr)


def test_wide_facts(wide):
    periods = rs.period_columns(wide.columns)
    facts = ins.wide_facts(rs.period_sums(wide, periods), periods).first()
    assert (facts["first_total"], facts["prev_total"], facts["latest_total"], facts["grand_total"]) == (108.0, 14.0, 131.0, 253.0)
    assert (facts["peak_period"], facts["low_period"]) == ("2021", "2020")
    assert facts["cagr_pct"] == pytest.approx(((131 / 108) ** 0.5 - 1) * 100)


def test_cagr_needs_three_periods_and_positive_ends(spark):
    df = spark.createDataFrame([(100.0, 5.0, 121.0)], "`2019` double, `2020` double, `2021` double")
    assert ins.wide_facts(rs.period_sums(df), ["2019", "2020", "2021"]).first()["cagr_pct"] == pytest.approx(10.0)
    two = df.select("2019", "2020")
    assert ins.wide_facts(rs.period_sums(two), ["2019", "2020"]).first()["cagr_pct"] is None


def test_categories_and_series(wide, rows_of):
    assert rs.category_columns(wide) == ["region", "name"]
    assert rows_of(rs.period_by_category(wide, "region")) == [("North", 124.0)]
    pivot = rs.multi_series_pivot(wide, "name", 2)
    assert pivot.columns == ["period", "alpha", "delta"]
    assert [tuple(r) for r in pivot.collect()] == [("2019", 100.0, 7.0), ("2020", 0.0, 7.0), ("2021", 121.0, 7.0)]


def test_wide_analysis(wide):
    a = analyze(wide, "growth_by_region.csv")
    assert a.is_wide and a.name == "Growth By Region" and a.total_rows == 4
    assert [r["label"] for r in a.kpis.collect()] == ["Latest Period (2021)", "Grand Total", "Period Average", "Growth (2020 → 2021)", "Distinct Region"]
    assert [c.kind for c in a.charts][:2] == ["line", "area"]
    kinds = [r["kind"] for r in a.insights.collect()]
    assert kinds == ["wide_growth", "wide_peak_low", "cagr", "wide_leader", "wide_bottom", "wide_span"]
    assert a.summary.first()["summary"].startswith("This analysis covers 4 records over 3 periods (2019 to 2021).")


@pytest.fixture(scope="module")
def sales(spark):
    groups = ["North", "South", "East", "West", "Mid", "Far"]
    rows = [(i, f"2024-01-{i % 10 + 1:02d}", groups[i % 6] if i % 9 else "North", "web" if i % 2 else "shop", 500 if i == 7 else i % 6 + 1, i % 4) for i in range(120)]
    return spark.createDataFrame(rows, "_row int, sale_date string, area string, channel string, amount int, items int")


def test_standard_analysis(sales):
    a = analyze(sales, "sales.csv", ["_row"])
    assert not a.is_wide and a.total_rows == 120
    assert [c.name for c in a.profile.numeric] == ["amount", "items"]
    assert [(c.kind, c.title) for c in a.charts] == [
        ("line", "Amount Over Sale Date"), ("bar", "Amount by Area"), ("pie", "Amount Share by Area"), ("bar", "Items by Channel"),
        ("area", "Items Trend"), ("scatter", "Amount vs Items"),
    ]
    pie = a.charts[2].data.collect()
    assert sum(r["share"] for r in pie) == pytest.approx(1.0)
    kinds = [r["kind"] for r in a.insights.collect()]
    assert {"leader", "bottom", "extreme_range"} <= set(kinds) and len(kinds) <= 10
    assert [r["label"] for r in a.kpis.collect()][:2] == ["Total Records", "Total Amount"]
    assert {r["column"] for r in a.filters.collect()} == {"area", "channel"}
    assert a.charts[0].description == "Trend of amount across 10 sale date periods." and a.charts[5].description.startswith("Shows a ")
    assert [c.samples[0] for c in a.profile.columns if c.name == "area"] == ["North"]
    assert a.context == "This appears to be a financial performance dataset. " + (
        'Note: columns "amount" (numeric, range: 1 – 500) may have abbreviated names from the source file.')
    a.release()


def test_refine(sales):
    a = analyze(sales, "sales.csv", ["_row"])
    part = refine(a, {"area": "South", "channel": ""}, ["_row"])
    assert part.total_rows == sales.where("area = 'South'").count()
    assert refine(a, {"area": "nowhere"}) is a
    direct = analyze_selected(a.source, a.name, {"area": "South", "channel": ""}, ["_row"], helpers=a.helpers)
    assert direct.total_rows == part.total_rows and direct.summary.collect() == part.summary.collect() and direct.kpis.collect() == part.kpis.collect()
    assert analyze_selected(a.source, a.name, {"area": "nowhere"}, ["_row"], helpers=a.helpers).total_rows == a.total_rows


def test_empty(spark):
    a = analyze(spark.createDataFrame([], "a int, b string"), "x.csv")
    assert a.summary.first()["summary"] == "No data to analyze." and a.total_columns == 2 and a.charts == []
    assert a.kpis.count() == a.insights.count() == a.filters.count() == 0


def test_fallback_charts_without_numbers(spark):
    df = spark.createDataFrame([(f"k{i % 12}",) for i in range(40)], "kind string")
    assert [(c.kind, c.title) for c in analyze(df, "x").charts] == [("horizontal-bar", "Records by Kind")]


def test_group_facts_ties_and_median(spark):
    groups = spark.createDataFrame([("b", 5.0, 1), ("a", 5.0, 1), ("d", 1.0, 2), ("c", 1.0, 2)], "name string, total double, count bigint")
    f = fx.group_facts(groups).first()
    assert (f["top_name"], f["bottom_name"], f["top3_names"], f["top3_total"]) == ("a", "d", '"a", "b", "c"', 11.0)
    assert fx.group_median(groups) == 1.0


def test_series_facts(spark):
    series = spark.createDataFrame([("2020", 1.0, 1), ("2021", 9.0, 1), ("2022", 9.0, 1), ("2023", 4.0, 1)], "period string, total double, count bigint")
    f = fx.series_facts(series).first()
    assert (f["first_period"], f["last_period"], f["prev_period"], f["peak_period"]) == ("2020", "2023", "2022", "2021")
    only = fx.series_facts(series.limit(1)).first()
    assert only["prev_period"] is None and only["periods"] == 1


def test_pearson(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(20)], "x double, y double")
    r = ch.pearson(line, "x", "y").first()
    assert r["r"] == pytest.approx(1.0) and (r["strength"], r["direction"]) == ("strong", "positive")
    flat = spark.createDataFrame([(float(i), 3.0) for i in range(20)], "x double, y double")
    r = ch.pearson(flat, "x", "y").first()
    assert (r["r"], r["strength"], r["direction"]) == (0.0, "weak", "no")


def test_group_sums_skip_blank_keys(spark, rows_of):
    df = spark.createDataFrame([(" a", "1"), ("a ", "x"), ("null", "5"), ("", "5"), (None, "5"), ("b", "2")], "k string, v string")
    assert rows_of(ch.group_sums(df, "k", ["v"])) == [("a", 1.0), ("b", 2.0)]
