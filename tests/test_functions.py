from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidframe.functions import coerce, dates, labels


def one(spark, values, fn, ddl="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_js_number_takes_only_plain_numbers(spark):
    values = ["12", " 3.5 ", "-1e3", ".5", "5.", "1d", "inf", "NaN", "12abc", "", None, " 7﻿"]
    assert one(spark, values, coerce.js_number) == [12.0, 3.5, -1000.0, 0.5, 5.0, None, None, None, None, None, None, 7.0]


def test_percent(spark):
    assert one(spark, ["12.5%", "n/a%", "%", " 40 % ", "7"], coerce.percent_number) == [0.125, None, None, 0.4, None]


def test_currency(spark):
    values = ["$1,234.50", "(1,000)", "Smith, J", "₱ 20", "$", "12", "€5"]
    assert one(spark, values, coerce.currency_number) == [1234.5, None, None, 20.0, None, None, 5.0]


def test_missing_rules_differ(spark):
    values = [None, "", "  ", "x"]
    assert one(spark, values, lambda c: coerce.is_missing(c, "null")) == [True, False, False, False]
    assert one(spark, values, lambda c: coerce.is_missing(c, "empty")) == [True, True, False, False]
    assert one(spark, values, lambda c: coerce.is_missing(c, "blank")) == [True, True, True, False]
    with pytest.raises(ValueError):
        coerce.is_missing(F.lit("x"), "other")


def test_group_key(spark):
    values = [" a ", "null", "undefined", " ", None, "b"]
    assert one(spark, values, coerce.group_key) == ["a", None, None, None, None, "b"]
    assert one(spark, values, lambda c: coerce.group_key(c, null_words=False))[1] == "null"


def test_squeeze_spaces(spark):
    assert one(spark, ["  a \t b 　c ", "plain"], coerce.squeeze_spaces) == ["a b c", "plain"]


def test_number_text(spark):
    assert one(spark, [1234.5, 7.0, 0.125, 1e7], coerce.number_text, "x double") == ["1234.5", "7", "0.125", "10000000"]


def test_large_numbers(spark):
    values = [999.0, 1500.0, 2.5e6, 1.234e9, 0.5, -1500.0, 0.0]
    expected = ["999", "1.5K", "2.5M", "1.23B", "0.50", "-1.5K", "0"]
    assert one(spark, values, labels.format_large_number, "x double") == expected
    assert [labels.large_number(v) for v in values] == expected


def test_large_number_styles(spark):
    values = [2_500_000.0, 1500.0, 12.0, 1.26e9]
    assert one(spark, values, lambda c: labels.format_large_number(c, "currency"), "x double") == ["₱2.5M", "₱2K", "₱12", "₱1.26B"]
    assert one(spark, values, lambda c: labels.format_large_number(c, "axis"), "x double") == ["2.5M", "1.5K", "12", "1.3B"]


def test_period_and_column_labels(spark):
    assert one(spark, ["2018 31", " 2020 ", "x 1"], labels.period_label) == ["2018 P31", "2020", "x 1"]
    names = ["user_id", "ContractCost", "2018 31", "2020", "GDP-total (usd)", "total"]
    expected = ["User Id", "Contract Cost", "2018 P31", "2020", "GDP Total (Usd)", "Total"]
    assert [labels.column_label(n) for n in names] == expected
    assert one(spark, names, labels.column_label_of) == expected


def test_slug_and_title(spark):
    assert one(spark, ["Region IV-A", "a.b c"], labels.slug) == ["region_iv_a", "a_b_c"]
    assert labels.dataset_title("sales_by-region.v2.csv") == "Sales By Region.V2"


def test_to_fixed_rounds_halves_up():
    assert [labels.to_fixed(v, 0) for v in (0.5, 2.5, -2.5, 1.4)] == ["1", "3", "-3", "1"]


def test_tolerant_dates(spark):
    values = ["2021-03-04", "2021/3/4", "2021-02-30", "2021", "2021-03", "", None, "2021-03-04 10:00:00", "x"]
    got = [str(d) if d else None for d in one(spark, values, dates.tolerant_date)]
    assert got == ["2021-03-04", "2021-03-04", None, None, None, None, None, "2021-03-04", None]
