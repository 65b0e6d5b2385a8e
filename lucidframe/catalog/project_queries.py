"""Queries over the project records: audit, dedup, cleaning, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import slug
from ..operators import audit, dedup, records, rollups
from ..sources import feature_json, tables
from .registry import register, view

RAW = ("projects_raw",)
TIE = ["_order", "_part", "_supp"]
ROW_KEY = ["contract_id", *TIE]

DEDUPED_SQL = """deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, contract_id
      ORDER BY infra_year DESC NULLS LAST, completion_year DESC NULLS LAST, _order, _part, _supp) AS rn
    FROM projects_raw) WHERE rn = 1)"""

# What a missing text becomes, and the numbers a missing one turns into zero.
_TEXT_DEFAULTS = {
    "region": "Unknown Region", "province": "Unknown Province", "municipality": "Unknown Municipality", "contractor": "Unknown Contractor",
    "project_description": "No Description", "type_of_work": "Unclassified", "infra_type": "Unclassified",
    **dict.fromkeys(["contract_id", "program", "funding_year", "start_date", "completion_date_actual", "implementing_office", "district_engineering_office", "legislative_district"], ""),
}
_ZERO_DEFAULTS = {"abc": "DOUBLE", "contract_cost": "DOUBLE", "infra_year": "INTEGER", "completion_year": "INTEGER"}
_DONE, _START = "TRY_CAST(completion_date_actual AS DATE)", "TRY_CAST(start_date AS DATE)"
_DUE = "CAST(EPOCH_MS(completion_date_original) AS DATE)"
_SAVED = "ifnull(abc, 0) - ifnull(contract_cost, 0)"
_KEY = "concat_ws('|', ifnull(contract_id, '\\N'), _order::VARCHAR, _part::VARCHAR, _supp::VARCHAR)"


def _text(name: str) -> str:
    return f"ifnull(trim({name}), '{_TEXT_DEFAULTS[name]}') AS {name}"


_CLEAN_COLUMNS = [
    f"ifnull(trim(project_id), 'UNK-' || md5({_KEY})) AS project_id",
    *[_text(name) for name in _TEXT_DEFAULTS],
    *[f"ifnull({name}, 0)::{kind} AS {name}" for name, kind in _ZERO_DEFAULTS.items()],
    f"({_SAVED})::DOUBLE AS cost_savings",
    f"ifnull({_DONE} > {_DUE}, FALSE) AS is_delayed",
    f"date_diff('day', {_START}, {_DONE})::BIGINT AS duration_days",
    "completion_date_original", "longitude", "latitude",
]
CLEAN_SQL = f"{DEDUPED_SQL}, projects AS (SELECT {', '.join(_CLEAN_COLUMNS)} FROM deduped)"


def _nulls(columns: dict[str, str], source: str) -> str:
    """Counts of null cells under the given names."""
    return ", ".join(f"COUNT(*) FILTER (WHERE {c} IS NULL) AS {name}" for name, c in columns.items()) + f" FROM {source}"


COST = "CAST(SUM(CAST(contract_cost AS DECIMAL(18,2))) AS DOUBLE)"
AVERAGE = f"{COST} / COUNT(contract_cost)"
DELAYED = "CAST(SUM(CASE WHEN is_delayed THEN 1 ELSE 0 END) AS BIGINT)"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "projects_raw")


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.dedup_records(raw(spark, sf_dir), TIE)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.clean_records(deduped(spark, sf_dir), ROW_KEY)


def on_clean(name: str, sql: str):
    return register(name, RAW, "WITH " + CLEAN_SQL + sql)


def on_deduped(name: str, sql: str):
    return register(name, RAW, "WITH " + DEDUPED_SQL + sql)


_AUDITED = {"region_nulls": "region", "province_nulls": "province", "cost_nulls": "contract_cost", "contractor_nulls": "contractor", "type_nulls": "type_of_work"}


@register("audit_nulls", RAW, f"SELECT COUNT(*) AS total_rows, {_nulls(_AUDITED, 'projects_raw')}")
def audit_nulls(spark, sf_dir):
    return audit.null_counts(raw(spark, sf_dir))


@register("audit_duplicates", RAW, "SELECT COUNT(*) - COUNT(DISTINCT {'p': project_id, 'c': contract_id}) AS duplicate_rows FROM projects_raw")
def audit_duplicates(spark, sf_dir):
    return audit.duplicate_count(raw(spark, sf_dir), records.RECORD_KEY)


@on_clean("audit_stage_counts", """
SELECT 'raw' AS stage, COUNT(*) AS row_count FROM projects_raw
UNION ALL SELECT 'deduplicated', COUNT(*) FROM deduped
UNION ALL SELECT 'clean', COUNT(*) FROM projects
UNION ALL SELECT 'exported', COUNT(*) FROM projects WHERE contract_cost > 0""")
def audit_stage_counts(spark, sf_dir):
    cleaned = clean(spark, sf_dir)
    return audit.stage_counts(
        {"raw": raw(spark, sf_dir), "deduplicated": deduped(spark, sf_dir), "clean": cleaned, "exported": records.with_cost(cleaned)}
    )


@on_deduped("dedup_keep_latest", "SELECT * FROM deduped")
def dedup_keep_latest(spark, sf_dir):
    return deduped(spark, sf_dir)


@on_clean("clean_projects", "SELECT * FROM projects")
def clean_projects(spark, sf_dir):
    return clean(spark, sf_dir)


_SHOWN = ["region", "province", "type_of_work", "contractor", "funding_year", "start_date", "municipality", "project_description", "infra_type", "program", "implementing_office"]


@register("clean_defaults", RAW, f"SELECT _order, _part, _supp, contract_id AS raw_contract_id, {', '.join(map(_text, _SHOWN))} FROM projects_raw")
def clean_defaults(spark, sf_dir):
    return raw(spark, sf_dir).select(
        *TIE,
        F.col("contract_id").alias("raw_contract_id"),
        *[records.text_or(F.col(n), records.DEFAULTS[n]).alias(n) for n in _SHOWN],
    )


@on_clean("surrogate_key_counts", """
SELECT COUNT(*) AS row_count, COUNT(DISTINCT project_id) AS distinct_ids,
  COUNT(CASE WHEN project_id LIKE 'UNK-%' THEN 1 END) AS surrogate_rows,
  COUNT(DISTINCT CASE WHEN project_id LIKE 'UNK-%' THEN project_id END) AS distinct_surrogates
FROM projects""")
def surrogate_key_counts(spark, sf_dir):
    made = F.col("project_id").startswith(records.SURROGATE_PREFIX)
    return clean(spark, sf_dir).agg(
        F.count("*").alias("row_count"),
        F.countDistinct("project_id").alias("distinct_ids"),
        F.count_if(made).alias("surrogate_rows"),
        F.countDistinct(F.when(made, F.col("project_id"))).alias("distinct_surrogates"),
    )


@register("cost_savings", RAW, f"SELECT _order, _part, _supp, contract_id, {_SAVED} AS cost_savings FROM projects_raw")
def cost_savings(spark, sf_dir):
    return raw(spark, sf_dir).select(*TIE, "contract_id", records.cost_savings().alias("cost_savings"))


@register("delay_flag", RAW, f"SELECT _order, _part, _supp, contract_id, ifnull({_DONE} > {_DUE}, FALSE) AS is_delayed FROM projects_raw")
def delay_flag(spark, sf_dir):
    return raw(spark, sf_dir).select(*TIE, "contract_id", records.is_delayed().alias("is_delayed"))


@register("duration_days", RAW, f"SELECT _order, _part, _supp, contract_id, date_diff('day', {_START}, {_DONE})::BIGINT AS duration_days FROM projects_raw")
def duration_days(spark, sf_dir):
    return raw(spark, sf_dir).select(*TIE, "contract_id", records.duration_days().alias("duration_days"))


_CORE = {f"{c}_nulls": c for c in ("region", "province", "project_description", "type_of_work", "contractor")}


@on_clean("validate_core_fields", f"""
SELECT * EXCLUDE (missing), missing = 0 AS passed, if(missing = 0, 'PASS', 'WARN') AS status
FROM (SELECT *, {' + '.join(_CORE)} AS missing FROM (SELECT {_nulls(_CORE, 'projects')}))""")
def validate_core_fields(spark, sf_dir):
    return audit.validate_no_nulls(clean(spark, sf_dir))


@on_clean("project_summary", f"""
SELECT COUNT(*) AS total_projects, COUNT(DISTINCT region) AS total_regions, COUNT(DISTINCT province) AS total_provinces,
  COUNT(DISTINCT municipality) AS total_municipalities, {COST} AS total_contract_cost,
  CAST(SUM(CAST(abc AS DECIMAL(18,2))) AS DOUBLE) AS total_abc, {AVERAGE} AS avg_cost,
  CAST(SUM(CAST(cost_savings AS DECIMAL(18,2))) AS DOUBLE) AS total_savings, {DELAYED} AS delayed_projects,
  AVG(duration_days) AS avg_duration_days
FROM projects WHERE contract_cost > 0""")
def project_summary(spark, sf_dir):
    return rollups.project_summary(clean(spark, sf_dir))


@on_clean("by_region", f"""
SELECT region, COUNT(*) AS project_count, {COST} AS total_cost, {AVERAGE} AS avg_cost, {DELAYED} AS delayed_count
FROM projects WHERE contract_cost > 0 GROUP BY region ORDER BY total_cost DESC""")
def by_region(spark, sf_dir):
    return rollups.by_region(clean(spark, sf_dir))


@on_clean("by_type_of_work", f"""
SELECT type_of_work, COUNT(*) AS project_count, {COST} AS total_cost, {AVERAGE} AS avg_cost
FROM projects WHERE contract_cost > 0 GROUP BY type_of_work ORDER BY total_cost DESC""")
def by_type_of_work(spark, sf_dir):
    return rollups.by_type_of_work(clean(spark, sf_dir))


@on_clean("by_funding_year", f"""
SELECT funding_year, COUNT(*) AS project_count, {COST} AS total_cost,
  CAST(SUM(CAST(cost_savings AS DECIMAL(18,2))) AS DOUBLE) AS savings
FROM projects WHERE contract_cost > 0 AND funding_year != '' GROUP BY funding_year ORDER BY funding_year""")
def by_funding_year(spark, sf_dir):
    return rollups.by_funding_year(clean(spark, sf_dir))


@on_clean("top_provinces", f"""
SELECT province, region, COUNT(*) AS project_count, {COST} AS total_cost
FROM projects WHERE contract_cost > 0 GROUP BY province, region ORDER BY total_cost DESC, province, region LIMIT 20""")
def top_provinces(spark, sf_dir):
    return rollups.top_provinces(clean(spark, sf_dir))


@on_clean("top_contractors", f"""
SELECT contractor, COUNT(*) AS project_count, {COST} AS total_cost
FROM projects WHERE contractor != 'Unknown Contractor' AND contract_cost > 0
GROUP BY contractor ORDER BY total_cost DESC, contractor LIMIT 15""")
def top_contractors(spark, sf_dir):
    return rollups.top_contractors(clean(spark, sf_dir))


@on_clean("distinct_regions", "SELECT DISTINCT region FROM projects WHERE contract_cost > 0 ORDER BY region")
def distinct_regions(spark, sf_dir):
    return rollups.distinct_regions(clean(spark, sf_dir))


@on_clean("distinct_years", "SELECT DISTINCT funding_year FROM projects WHERE funding_year != '' ORDER BY funding_year")
def distinct_years(spark, sf_dir):
    return rollups.distinct_years(clean(spark, sf_dir))


@on_clean("drill_region", f"""
SELECT region, province, COUNT(*) AS project_count, {COST} AS total_cost
FROM projects WHERE contract_cost > 0 GROUP BY region, province""")
def drill_region(spark, sf_dir):
    return rollups.drill_region(clean(spark, sf_dir))


@on_clean("drill_year", f"""
SELECT funding_year, region, COUNT(*) AS project_count, {COST} AS total_cost, {DELAYED} AS delayed_count
FROM projects WHERE contract_cost > 0 AND funding_year != '' GROUP BY funding_year, region""")
def drill_year(spark, sf_dir):
    return rollups.drill_year(clean(spark, sf_dir))


@on_clean("compact_projection", f"SELECT {', '.join(records.COMPACT_COLUMNS)} FROM projects WHERE contract_cost > 0")
def compact_projection(spark, sf_dir):
    return records.compact(clean(spark, sf_dir))


@on_clean("slug", """
SELECT type_of_work, lower(regexp_replace(type_of_work, '[^a-zA-Z0-9]', '_', 'g')) AS slug, COUNT(*) AS project_count
FROM projects GROUP BY type_of_work""")
def slug_query(spark, sf_dir):
    grouped = clean(spark, sf_dir).groupBy("type_of_work").agg(F.count("*").alias("project_count"))
    return grouped.withColumn("slug", slug(F.col("type_of_work")))


@register("src_parquet_view_sql", (), """
SELECT l_returnflag AS return_flag, COUNT(*) AS row_count, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
FROM lineitem WHERE l_quantity >= 10 GROUP BY l_returnflag""")
def src_parquet_view_sql(spark, sf_dir):
    tables.register_view(spark, f"{sf_dir}/lineitem.parquet", "projects")
    return tables.run_sql(spark, """
        SELECT l_returnflag AS return_flag, COUNT(*) AS row_count,
          CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
        FROM projects WHERE l_quantity >= 10 GROUP BY l_returnflag""")


@register("src_feature_collection", RAW, "SELECT * EXCLUDE (_order, _part, _supp) FROM projects_raw")
def src_feature_collection(spark, sf_dir):
    documents = feature_json.to_documents(raw(spark, sf_dir))
    return feature_json.from_documents(documents)
