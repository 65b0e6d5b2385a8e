"""Filling, ranks, moments, semantic types, written dates, redundant columns and outliers against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.operators import imputation, mixed_dates, moments, redundancy, semantics
from lucidframe.operators import statistics as st
from lucidframe.operators.ranges import range_bounds, range_index

EVENTS = "id long, who string, at int, v double, t string"


def events(rng, n=400):
    """Most rows belong to one entity; null entities are one."""
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), i * 3 % 1000, None if rng.random() < 0.6 else float(i), rng.choice([None, "", "x", "y"])) for i in range(n)]
    rng.shuffle(rows)
    return rows


def carried(rows, backward):
    out, last = {}, {}
    for i, who, _, v, t in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2], reverse=backward):
        held = last.setdefault(who, [None, None])
        held[0], held[1] = v if v is not None else held[0], t or held[1]
        out[i] = (held[0], held[1] if held[1] is not None else t)
    return out | {r[0]: (r[3], r[4]) for r in rows if r[2] is None}


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_carry_equals_a_walk_through_every_entity(spark, backward, parts):
    rows = [*events(random.Random(parts)), (9001, "hot", None, None, None), (9002, "hot", None, 5.0, "z")]
    out = imputation.carry(spark.createDataFrame(rows, EVENTS), ["v", "t"], ["who"], ["at"], backward=backward, ids=[], parts=parts)
    assert out.columns == ["id", "who", "at", "v", "t"]
    assert {r.id: (r.v, r.t) for r in out.collect()} == carried(rows, backward)


def test_carry_by_dates_and_of_empty_tables(spark):
    day = dt.date(2024, 1, 1)
    rows = [(i, "a", day + dt.timedelta(days=i), None if i % 3 else i) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, who string, day date, v int")
    assert [r.v for r in imputation.carry(df, ["v"], ["who"], ["day"], ids=[], parts=5).orderBy("id").collect()] == [i - i % 3 for i in range(30)]
    assert imputation.carry(df.limit(0), ["v"], ["who"], ["day"], ids=[]).count() == 0
    assert imputation.fill_by_group(df.limit(0), {"v": "median"}, ["who"], ids=[]).count() == 0


def test_ids_are_never_filled(spark):
    df = spark.createDataFrame([(i, "a", i, None if i % 2 else 1.0) for i in range(40)], "order_id long, who string, at int, v double")
    with pytest.raises(imputation.IdentifierError):
        imputation.carry(df, ["order_id"], ["who"], ["at"])
    with pytest.raises(imputation.IdentifierError):
        imputation.fill_by_group(df, {"v": "mean"}, ["who"], ids=["v"])
    assert imputation.drop_missing(df, ["v"]).count() == 20


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_groups_are_filled_with_their_own_statistic(spark, parts):
    rows = events(random.Random(8))
    df = spark.createDataFrame(rows, EVENTS).withColumn("m", F.col("v"))
    out = imputation.fill_by_group(df, {"v": "median", "m": "mean", "t": "mode"}, ["who"], ids=[], parts=parts)
    of = {who: [r for r in rows if r[1] == who] for who in {r[1] for r in rows}}
    median = {who: sorted(v)[len(v) // 2] for who, g in of.items() if (v := [r[3] for r in g if r[3] is not None])}
    mean = {who: np.mean([r[3] for r in g if r[3] is not None]) for who, g in of.items()}
    mode = {who: min("xy", key=lambda t: (-sum(r[4] == t for r in g), t)) for who, g in of.items()}  # noqa: B023
    for r in out.collect():
        _, who, _, v, t = next(x for x in rows if x[0] == r.id)
        assert r.v == (median[who] if v is None else v) and r.m == pytest.approx(mean[who] if v is None else v) and r.t == (t or mode[who])


def test_range_index_counts_the_bounds_below(spark):
    df = spark.createDataFrame([(float(i % 97),) for i in range(1000)] + [(None,)], "v double")
    bounds = range_bounds(df, F.col("v"), 30)
    assert len(bounds) <= 29
    for v, index in df.select("v", range_index(F.col("v"), bounds)).distinct().collect():
        assert index == (None if v is None else sum(b <= v for b in bounds))


def test_rank_correlation_of_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), rng.random() ** 3, None if rng.random() < 0.2 else rng.randrange(50), 1) for _ in range(300)]
    got = {(r.first, r.second): (r.n, r.r) for r in moments.spearman(spark.createDataFrame(rows, "a int, b double, c int, d int"), ["a", "b", "c", "d"], parts=7).collect()}
    full = [r for r in rows if None not in r]
    ranks = np.array([[sum(y < x for y in col) + (sum(y == x for y in col) + 1) / 2 for x in col] for col in zip(*full, strict=True)])
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            if i < j:
                n, r = got[a, b]
                assert n == len(full) and (r is None if b == "d" else r == pytest.approx(np.corrcoef(ranks[i], ranks[j])[0, 1]))


def test_moments_keep_the_digits_of_large_numbers_and_see_pairs_only(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=500)
    rows = [(1e9 + float(v), float(v) * 2 + float(rng.normal()), None if i % 4 == 0 else str(float(v) + float(rng.normal())), float("nan") if i % 5 == 0 else 1.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c string, d double").repartition(5)
    got = {(r.first, r.second): (r.n, r.r) for r in moments.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    a, b, c = (np.array([float(r[i]) if r[i] is not None else np.nan for r in rows]) for i in range(3))
    has = ~np.isnan(c)
    assert got["a", "b"] == (500, pytest.approx(np.corrcoef(a, b)[0, 1])) and got["a", "c"] == (375, pytest.approx(np.corrcoef(a[has], c[has])[0, 1]))
    assert got["d", "d"] == (400, None) and got["a", "a"][1] == pytest.approx(1)
    fit = moments.linear_fit(df.drop("d").withColumn("twice", 2 * F.col("b")), "a", ["b", "twice"])
    slope = np.polyfit(b, a - 1e9, 1)
    assert fit.coefficients[0] + 2 * fit.coefficients[1] == pytest.approx(slope[0]) and fit.n == 500
    both = df.withColumn("twice", 2 * F.col("b"))
    off = both.select(F.sqrt(F.avg((fit.predicted(both) - F.col("a")) ** 2))).first()[0]
    assert off == pytest.approx(fit.rmse, rel=1e-3) and moments.linear_fit(df.limit(0), "a", ["b"]).n == 0
    assert [r.n for r in moments.correlation_matrix(df.limit(0), ["a"]).collect()] == [0]


def test_semantic_types_validate_and_grade(spark):
    cards = ["4111 1111 1111 1111", "5500-0000-0000-0004", "4111 1111 1111 1112"]
    rows = [
        (cards[0], "a@b.co", "12.5, 99.0", "10.0.0.1", "2024-02-29", " ", "x", "True"), (cards[1], "bad@", "91.0, 5.0", "10.0.0.256", "2024-02-30", None, "7", "NO"),
        (cards[1], "c.d@e.org", "-3.5;170.25", "1.2.3.4", "2024/1/5", "", "text", "y"), (cards[2], "x@y.zz", "1.5, 181.0", "8.8.8.8", "2023-12-01", None, "+49 30 1234567", "n"),
    ]
    got = {r.column: tuple(r)[1:] for r in semantics.semantic_types(spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(8)))).collect()}
    assert got == {
        "c0": (4, "card_number", 3, 0.75, "low"), "c1": (4, "email", 3, 0.75, "low"), "c2": (4, "coordinates", 2, 0.5, "low"), "c3": (4, "ip_address", 3, 0.75, "low"),
        "c4": (4, "date", 3, 0.75, "low"), "c5": (0, "text", 0, None, None), "c6": (4, "text", 1, 0.25, None), "c7": (4, "boolean", 4, 1.0, "high"),
    }


def test_dates_follow_the_column(spark):
    rows = [("25/12/2023", "12-25-2023", "01/02/2024"), ("03/04/2023", "03-04-2023", "05/05/2024"), ("2021-02-30", "Feb 29, 2024", " "), ("31 Sept 2020", "5 march 2020", "20240131"), ("30/02/2020", "soon", None), ("1.2.2020 ", "13/13/2020", "99999999")]
    df = spark.createDataFrame(rows, "eu string, us string, none string")
    formats = mixed_dates.infer_date_formats(df, ["eu", "us", "none"])
    assert [formats[c].day_first for c in ("eu", "us", "none")] == [True, False, None]
    got = mixed_dates.parse_dates(df, ["eu", "us", "none"]).collect()
    day = dt.date
    assert [(r.eu_date, r.eu_status) for r in got] == [(day(2023, 12, 25), "parsed"), (day(2023, 4, 3), "parsed"), (None, "invalid"), (None, "invalid"), (None, "invalid"), (day(2020, 2, 1), "parsed")]
    assert [(r.us_date, r.us_status) for r in got] == [(day(2023, 12, 25), "parsed"), (day(2023, 3, 4), "parsed"), (day(2024, 2, 29), "parsed"), (day(2020, 3, 5), "parsed"), (None, "unknown"), (None, "invalid")]
    assert [(r.none_date, r.none_status) for r in got] == [(day(2024, 1, 2), "ambiguous"), (day(2024, 5, 5), "parsed"), (None, "missing"), (day(2024, 1, 31), "parsed"), (None, "missing"), (None, "unknown")]
    assert mixed_dates.parse_dates(df, ["none"], day_first=True).first().none_date == day(2024, 2, 1)


def test_redundant_columns(spark):
    rows = [(1, "1", 1.0, "x", None, "k", "2"), (2, "2", 2.0, "x", None, "k", "1"), (2, "2", 2.0, "y", None, "k", "2"), (None, None, None, "x", None, "k", None)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string, e string, f string, g string")
    assert sorted(tuple(r) for r in redundancy.duplicate_columns(df).collect()) == [("b", "a")]
    assert redundancy.duplicate_columns(df.limit(0)).count() == 0
    assert sorted(tuple(r) for r in redundancy.constant_columns(df, nearly=0.7).collect()) == [("d", "nearly constant", 0.75), ("e", "empty", 0.0), ("f", "constant", 1.0)]


def test_scores(spark):
    values = [1.0, 2.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v, 7.0, str(v)) for v in values] + [(None, 7.0, "no")], "v double, same double, t string")
    got = st.z_scores(df, ["v", "same", "t"], 2).collect()
    expected = (np.array(values) - np.mean(values)) / np.std(values)
    assert [r.v_score for r in got] == pytest.approx([*expected, None]) and [r.v_outlier for r in got] == [False] * 5 + [True, False]
    assert [r.t_score for r in got] == [r.v_score for r in got] and not any(r.same_outlier for r in got)
    got = st.modified_z_scores(df, ["v", "same"]).collect()
    assert [r.v_score for r in got] == pytest.approx([0.6745 * (v - 3) / 1 for v in values] + [None]) and got[5].v_outlier and got[0].same_score is None
