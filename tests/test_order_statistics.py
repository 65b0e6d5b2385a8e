from __future__ import annotations

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lucidframe.operators.order_statistics import lower_quartile, order_statistics, upper_median, upper_quartile

POSITIONS = {"q1": lower_quartile, "median": upper_median, "q3": upper_quartile, "least": lambda n: 0, "last": lambda n: n - 1}


def expected(values):
    kept = sorted(v for v in values if v is not None and v == v)
    return {"n": len(kept), **{p: kept[f(len(kept))] if kept else None for p, f in POSITIONS.items()}}


def frame(spark, **columns):
    names = list(columns)
    return spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.mark.parametrize("limit", [10_000_000, 200, 1])
def test_matches_sorting_on_either_way(spark, limit):
    rng = random.Random(7)
    n = 3000
    columns = {
        "spread": [rng.gauss(0, 1000) for _ in range(n)],
        # One value holds a third of all rows.
        "hot": [5.0 if rng.random() < 0.34 else float(rng.randint(0, 10)) for _ in range(n)],
        "constant": [1.5] * n,
        "gaps": [None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else rng.random() for _ in range(n)],
        "outliers": [1e12 if i == 3 else rng.random() for i in range(n)],
    }
    df = frame(spark, **columns)
    got = order_statistics(df, {c: F.col(c) for c in columns}, POSITIONS, gathered=limit, accuracy=50)
    assert got == {c: expected(v) for c, v in columns.items()}


def test_small_and_empty(spark):
    df = frame(spark, a=[float(i) for i in range(1, 8)], b=[None] * 7)
    got = order_statistics(df, {"a": F.col("a"), "b": F.col("b")}, POSITIONS)
    assert (got["a"]["q1"], got["a"]["q3"]) == (2.0, 6.0)
    assert got["b"] == {"n": 0, **dict.fromkeys(POSITIONS)}
    four = frame(spark, a=[1.0, 2.0, 3.0, 4.0])
    assert order_statistics(four, {"a": F.col("a")}, {"m": upper_median})["a"]["m"] == 3.0
    assert order_statistics(four, {}, POSITIONS) == {}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 2.0])), min_size=1, max_size=80))
def test_property(spark, values):
    df = frame(spark, a=values)
    assert order_statistics(df, {"a": F.col("a")}, POSITIONS, gathered=1, accuracy=10)["a"] == expected(values)


@pytest.mark.parametrize("gathered", [1, 50_000])
def test_large_integers_and_decimals_keep_their_digits(spark, gathered):
    big = 9007199254740993
    rows = [(big + i % 5, Decimal("0.1") * (i % 7) + Decimal("12345678901234567890.5")) for i in range(200)]
    df = spark.createDataFrame(rows, "a bigint, b decimal(30,1)")
    got = order_statistics(df, {"a": F.col("a"), "b": F.col("b")}, POSITIONS, gathered=gathered, accuracy=50)
    assert got == {"a": expected([r[0] for r in rows]), "b": expected([r[1] for r in rows])}
    same = spark.createDataFrame([(big,)] * 3, "a bigint")
    assert order_statistics(same, {"a": F.col("a")}, {"m": upper_median}, gathered=gathered)["a"]["m"] == big
