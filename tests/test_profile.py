from __future__ import annotations

import pytest

from lucidframe.operators import profile as prof


def types_of(df):
    return {r["column"]: r["type"] for r in prof.detect_column_types(df).collect()}


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (
            i, i % 3, f"{2000 + i % 5}", f"2021-01-{i % 28 + 1:02d}", "long " * 30, "red" if i % 2 else "blue", f"name {i}",
            float(i) * 1.5, "" if i % 4 else "7", i % 2 == 0, None, None if i % 10 else "2001",
        )
        for i in range(60)
    ]
    ddl = (
        "id int, user_id int, year string, seen string, story string, color string, label string, amount double, "
        "rare string, flag boolean, nothing string, updated_year string"
    )
    return spark.createDataFrame(rows, ddl)


def test_type_rules(table):
    assert types_of(table) == {
        "id": "id",  # by its name, near unique
        "user_id": "numeric",  # `_` is a word character, so the name says nothing
        "year": "temporal",
        "seen": "temporal",  # by its values
        "story": "text",  # long
        "color": "categorical",
        "label": "text",  # near unique
        "amount": "id",  # near-unique numbers
        "rare": "numeric",
        "flag": "numeric",  # booleans count as numbers
        "nothing": "categorical",
        "updated_year": "temporal",  # mostly empty, but years
    }


def test_period_is_temporal_and_small_tables_have_no_ids(spark):
    df = spark.createDataFrame([(str(2000 + i), float(i)) for i in range(10)], "period string, v double")
    assert types_of(df) == {"period": "temporal", "v": "numeric"}


def test_counts_statistics_and_top_values(table, spark):
    counts = {r["column"]: (r["null_count"], r["unique_count"]) for r in prof.profile_columns(table).collect()}
    assert counts["rare"] == (45, 1) and counts["nothing"] == (60, 0) and counts["story"] == (0, 1)
    p = prof.profile(table)
    assert p.rows == 60 and {c.name: c for c in p.columns}["user_id"].stats == {"min": 0.0, "max": 2.0, "sum": 60.0, "mean": 1.0, "median": 1.0}
    assert {c.name: c for c in p.columns}["color"].top == [("blue", 30), ("red", 30)]
    exact = {r["column"]: r["unique_count"] for r in prof.distinct_counts(table).collect()}
    rough = {r["column"]: r["unique_count"] for r in prof.distinct_counts(table, approximate=True).collect()}
    assert all(abs(rough[c] - n) <= 0.1 * n + 1 for c, n in exact.items())


def test_top_values_tie_and_limit(spark):
    df = spark.createDataFrame([(f"v{i:02d}",) for i in range(30)] + [("v29",)], "x string")
    top = [(r["rank"], r["value"], r["count"]) for r in prof.top_values(df).orderBy("rank").collect()]
    assert len(top) == 20 and top[:2] == [(1, "v29", 2), (2, "v00", 1)]


def test_first_values_follow_row_order(spark):
    df = spark.createDataFrame([(9 - i, None if i == 9 else f"x{i}") for i in range(10)], "o int, x string").repartition(4)
    got = [r["value"] for r in prof.first_values(df, ["o"], ["x"], 3).orderBy("position").collect()]
    assert got == ["x8", "x7", "x6"]


def test_filters(spark):
    rows = [(f"c{i % 3}x", str(i % 4), "only", f"t{i}") for i in range(80)]
    df = spark.createDataFrame(rows, "kind string, digit string, same string, many string")
    assert {r["column"] for r in prof.filter_options(df).collect()} == {"kind"}
    assert prof.usable_values([("12/", 1), ("a", 1), ("ab", 1)]) == [("ab", 1)]


def test_context(spark):
    df = spark.createDataFrame([(i % 7, "x") for i in range(40)], "amount int, note string")
    text = prof.dataset_context(df, "Loan Book").first()["context"]
    assert text == 'This appears to be a lending/credit dataset. Note: columns "amount" (numeric, range: 0 – 6) may have abbreviated names from the source file.'
    assert prof.context_text("Loan Book", df.columns, prof.profile(df)) == text


def test_strict_ids_keep_measures_numeric(spark):
    df = spark.createDataFrame([(i, i + 0.5) for i in range(30)], "code int, size double")
    types = lambda **how: {r["column"]: r["type"] for r in prof.detect_column_types(df, **how).collect()}
    assert types() == {"code": "id", "size": "id"}
    assert types(strict_ids=True) == {"code": "id", "size": "numeric"}
