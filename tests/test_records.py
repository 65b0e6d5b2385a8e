from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lucidframe.operators import audit, dedup, records, rollups
from lucidframe.plans import project_flow
from lucidframe.sources import feature_json

DDL = ", ".join(f"{column} {kind}" for _, column, kind in feature_json.ATTRIBUTES)
DAY = 86_400_000


def project(**values):
    base = {
        "infra_year": 2020, "region": " R1 ", "province": "P1", "municipality": "M1", "project_id": "A", "contract_id": "C1",
        "project_description": "d", "type_of_work": "t", "infra_type": "i", "contractor": "K", "abc": 12.0, "contract_cost": 10.0,
        "completion_date_original": 18_628 * DAY, "completion_year": 2021, "funding_year": "2020",
        "completion_date_actual": "2021-01-02", "start_date": "2020-12-30",
    }
    base.update(values)
    return tuple(base.get(column) for _, column, _ in feature_json.ATTRIBUTES)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        project(),
        project(infra_year=2021, contractor="newer"),
        project(infra_year=2021, completion_year=None, contractor="unfinished"),
        project(project_id=None, contract_id=None, region=None, contract_cost=5.0),
        project(project_id=None, contract_id=None, region=None, contract_cost=5.0, infra_year=2019),
        project(project_id="B", completion_date_actual="2021-01-01", contractor=None, funding_year=None),
        project(project_id="C", completion_date_actual="2021-02-30", abc=None, province="", contract_cost=None),
        project(project_id="D", start_date="", region="R'2", contract_cost=100.0, abc=1.0),
        project(project_id="E", completion_date_original=None, start_date="2021-01-05"),
    ]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def clean(raw):
    return records.clean_records(records.dedup_records(raw)).persist()


def by_id(clean):
    return {r["project_id"]: r for r in clean.collect()}


def test_dedup_keeps_newest_and_groups_null_keys(raw):
    rows = records.dedup_records(raw).collect()
    assert len(rows) == 6
    assert [r["contractor"] for r in rows if r["project_id"] == "A"] == ["newer"]
    assert [r["infra_year"] for r in rows if r["project_id"] is None] == [2020]


def test_clean_schema_and_defaults(clean):
    rows = by_id(clean)
    assert len(clean.columns) == 26
    assert rows["A"]["region"] == "R1"
    assert rows["B"]["contractor"] == "Unknown Contractor" and rows["B"]["funding_year"] == ""
    assert rows["C"]["province"] == "" and rows["C"]["abc"] == 0.0 and rows["C"]["contract_cost"] == 0.0
    made = [k for k in rows if k.startswith("UNK-")]
    assert len(made) == 1 and rows[made[0]]["region"] == "Unknown Region" and rows[made[0]]["contract_id"] == ""
    assert rows["D"]["cost_savings"] == -99.0


def test_delay_and_duration(clean):
    rows = by_id(clean)
    assert rows["A"]["is_delayed"] is True and rows["A"]["duration_days"] == 3
    # The original day itself is not late.
    assert rows["B"]["is_delayed"] is False
    assert rows["C"]["is_delayed"] is False and rows["C"]["duration_days"] is None
    assert rows["D"]["duration_days"] is None
    assert rows["E"]["is_delayed"] is False and rows["E"]["duration_days"] == -3


def test_integer_casts_round_half_even(spark):
    df = spark.createDataFrame([(3.7,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(records.number_or_zero(F.col("x"), "int")).collect()] == [4, 2, 0]


def test_surrogate_keys_do_not_depend_on_partitioning(raw):
    a = {r["project_id"] for r in records.clean_records(records.dedup_records(raw)).collect()}
    b = {r["project_id"] for r in records.clean_records(records.dedup_records(raw.repartition(7))).collect()}
    assert a == b


def test_audit(raw, clean):
    nulls = audit.null_counts(raw).first()
    assert (nulls["total_rows"], nulls["region_nulls"], nulls["cost_nulls"], nulls["contractor_nulls"]) == (9, 2, 1, 1)
    assert audit.duplicate_count(raw, records.RECORD_KEY).first()["duplicate_rows"] == 3
    assert audit.validate_no_nulls(clean).first()["status"] == "PASS"
    assert audit.validate_no_nulls(raw).first()["passed"] is False
    assert {r["stage"]: r["row_count"] for r in audit.stage_counts({"raw": raw, "clean": clean}).collect()} == {"raw": 9, "clean": 6}


def test_exact_duplicates_are_found_before_trimming(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a ", 1)], "x string, y int")
    assert dedup.drop_exact_duplicates(df).count() == 2


def test_reports_agree_with_each_other(clean):
    summary = rollups.project_summary(clean).first()
    regions = rollups.by_region(clean).collect()
    assert sum(r["project_count"] for r in regions) == summary["total_projects"] == 5
    assert sum(r["total_cost"] for r in regions) == summary["total_contract_cost"]
    assert sum(r["delayed_count"] for r in regions) == summary["delayed_projects"]
    assert summary["total_abc"] - summary["total_contract_cost"] == pytest.approx(summary["total_savings"])
    assert summary["avg_cost"] == summary["total_contract_cost"] / summary["total_projects"]
    assert [r["total_cost"] for r in regions] == sorted((r["total_cost"] for r in regions), reverse=True)
    drill = rollups.drill_region(clean).groupBy("region").sum("total_cost").collect()
    assert {r[0]: r[1] for r in drill} == {r["region"]: r["total_cost"] for r in regions}
    assert [r["funding_year"] for r in rollups.distinct_years(clean).collect()] == ["2020"]
    assert all(r["contractor"] != "Unknown Contractor" for r in rollups.top_contractors(clean).collect())


def test_flow_writes_everything(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    result = project_flow.run(spark, raw, out)
    assert result.stages == {"raw": 9, "clean": 6, "exported": 5}
    assert result.duplicates == 3 and result.validation["status"] == "PASS"
    assert spark.read.parquet(f"{out}/compact").columns == records.COMPACT_COLUMNS
    summary = spark.read.json(f"{out}/reports/summary").first()
    assert summary["total_projects"] == 5
    drill = spark.read.json(f"{out}/drill_region")
    assert {r[0] for r in drill.select("slug").distinct().collect()} == {"r1", "r_2", "unknown_region"}
    # Ranked within each folder; the record without a year is in no year folder.
    assert spark.read.json(f"{out}/drill_year").groupBy().sum("project_count").first()[0] == 4
