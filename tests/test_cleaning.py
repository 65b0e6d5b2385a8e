from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidframe.operators import cleaning


@pytest.fixture(scope="module")
def messy(spark):
    rows = [
        (1, "YES", "$1,000", "10%", 1.0),
        (2, "yes", "(1,000)", "n/a%", 2.0),
        (3, "No", "Smith, J", "5%", 3.0),
        (4, "NEW  YORK", "€20", None, 4.0),
        (5, "new york", "", "7%", 5.0),
        (6, " Maybe ", "12", "8%", 6.0),
        (7, None, None, "", 100.0),
        (7, None, None, "", 100.0),
    ]
    return spark.createDataFrame(rows, "id int, ` answer\t` string, money string, rate string, size double")


def test_clean_names():
    assert cleaning.clean_name(" a\tb  c ") == "ab c"
    assert cleaning.clean_name("  ") == "  "
    assert cleaning.suffix_repeats(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]


def test_names_that_collide_are_kept_apart(spark):
    df, mapping = cleaning.fix_column_names(spark.createDataFrame([(1, 2)], "`a ` int, a int"))
    assert df.columns == ["a", "a_1"] and mapping == {"a ": "a", "a": "a_1"}


def test_index_quartiles_and_flags(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 8)] + [(1000.0,)], "x double")
    fences = cleaning.iqr_fences(df)["x"]
    assert (fences.n, fences.q1, fences.q3) == (8, 3.0, 7.0)
    assert [r["x"] for r in cleaning.flag_outliers(df).where("x_outlier").collect()] == [1000.0]
    three = df.limit(3)
    assert cleaning.iqr_fences(three) == {} and cleaning.outlier_report(three).count() == 0


def test_whole_pass(messy):
    result = cleaning.clean_dataset(messy)
    rows = {r["id"]: r for r in result.df.collect()}
    assert result.df.columns == ["id", "answer", "money", "rate", "size"]
    assert [rows[i]["answer"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["Yes", "Yes", "No", "New york", "New york", "Maybe", None]
    assert [rows[i]["money"] for i in (1, 2, 3, 4, 5, 6)] == ["1000", "(1,000)", "Smith, J", "20", "", "12"]
    assert [rows[i]["rate"] for i in (1, 2, 4)] == ["0.1", "n/a%", None]
    assert (result.original_rows, result.cleaned_rows, result.duplicates_removed) == (8, 7, 1)
    report = {r["step"]: (r["affected_rows"], r["affected_columns"]) for r in result.report.collect()}
    assert report["Remove duplicates"][0] == 1
    assert report["Fix column names"] == (7, ["answer"])
    assert report["Handle missing values"] == (0, ["answer", "money", "rate"])
    assert report["Detect outliers"] == (0, ["size"])
    assert report["Normalize text"] == (2, ["answer"])
    assert report["Clean categoricals"] == (4, ["answer"])
    assert report["Clean numbers"] == (6, ["money", "rate"])


def test_variants_give_the_same_result_by_broadcast_and_by_shuffle(spark, rows_of):
    # One text fills more than a third of the table.
    rows = [(i, "HOT" if i % 5 < 2 else "hot" if i % 5 == 2 else f"Word{i % 7}", None if i % 3 else "x") for i in range(600)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(4)
    merged = cleaning.merge_case_variants(df)
    found = rows_of(merged)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert rows_of(cleaning.merge_case_variants(df)) == found
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r[0] for r in merged.where("i % 5 < 3").select("a").distinct().collect()} == {"Hot"}


def test_variants_of_blank_text_are_left_alone(spark, rows_of):
    df = spark.createDataFrame([("",), (" ",), ("x",)], "a string")
    assert rows_of(cleaning.merge_case_variants(df)) == rows_of(df)


def test_promote_only_full_columns(spark):
    df = spark.createDataFrame([("1", "1", ""), ("2.5", "x", ""), (None, "2", "")], "a string, b string, c string")
    out = cleaning.promote_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string", "c": "string"}


def test_missing_report_counts_null_and_empty_only(messy):
    got = {r["column"]: r["missing"] for r in cleaning.missing_report(messy).collect()}
    assert got == {"id": 0, " answer\t": 2, "money": 3, "rate": 3, "size": 0}


def test_text_report(messy):
    got = {r["column"]: r["changed_cells"] for r in cleaning.normalize_text_report(messy).collect()}
    assert got == {" answer\t": 2, "money": 0, "rate": 0}
    assert cleaning.normalize_text(messy).where(F.col("` answer\t`") == "NEW YORK").count() == 1
