"""The registered queries: complete, and some of them against their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries
from lucidframe.catalog import ORACLE, QUERIES
from lucidframe.catalog.views import TABLES, VIEWS, view, view_sql
from tools.check import compare

needs_tables = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables are not here")

SOME = [
    "audit_duplicates", "by_funding_year", "drill_year", "src_parquet_view_sql", "dedup_exact", "outliers_iqr", "merge_case_variants",
    "parse_currency", "profile_columns", "detect_column_types", "unpivot_periods", "cagr", "insight_wide_category", "time_series_sums",
    "pearson_strength", "insight_leader", "insight_peak", "norm_min_two_nonnull", "text_table_cells", "document_table_detect", "grid_header_fill",
    "stream_running_totals", "grid_header_row", "grid_cells", "pie_share_of_all", "area_over_time", "audit_nulls", "clean_defaults", "validate_core_fields",
    "clean_projects", "filter_options", "filtered_reanalysis", "describe_measures", "category_association", "integrity_report", "autocorrelation_days", "src_csv_normalized", "grid_table",
    "impute_fill", "impute_groups", "spearman_strength", "correlation_matrix", "linear_fit", "semantic_types", "parse_dates", "duplicate_columns", "constant_columns",
    "outliers_zscore", "outliers_modified_z", "principal_components", "logistic_fit", "kmeans_clusters", "synonym_report", "merge_synonyms", "quality_score", "stream_profile",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE_DIR}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE) <= set(queries()) and set(oracle_sql()) <= set(queries()) and len(QUERIES) >= 95


@needs_tables
def test_entry(spark):
    assert entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", list(VIEWS))
def test_views_hold_the_same_rows_on_both_engines(spark, con, name):
    expected = con.execute(f"WITH {view_sql(name)} SELECT COUNT(*) FROM {name}").fetchone()[0]
    assert view(spark, SMOKE_DIR, name).count() == expected


@needs_tables
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    message, _, ok = compare(spark, con, SMOKE_DIR, name, queries()[name], oracle_sql()[name])
    assert ok, message
