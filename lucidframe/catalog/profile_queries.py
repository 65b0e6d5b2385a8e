"""Queries that profile whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from ..operators import profile
from ..operators.order_statistics import lower_quartile, order_statistics, upper_median, upper_quartile
from . import sql_text as q
from .registry import register, view
from .views import read

EVENTS = ["event_id", "event_day", "event_type", "value", "user_id"]
LINES = ["order_no", "ship_date", "return_flag", "line_status", "quantity", "price", "discount", "tax"]
CONTACTS = ["c_custkey", "segment", "balance_text", "rate_text", "note", "balance"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
MEASURES = ["quantity", "price", "discount", "tax"]


def lines(spark, sf_dir):
    return view(spark, sf_dir, "line_facts").select(*LINES)


def events(spark, sf_dir):
    return view(spark, sf_dir, "event_facts")


def contacts(spark, sf_dir):
    return view(spark, sf_dir, "dirty_customers")


# A full profile reads its table several times, so these views are persisted: made up
# once, spilled where memory is short, made up again where an executor is lost.
def kept_lines(spark, sf_dir):
    return lines(spark, sf_dir).persist()


def kept_events(spark, sf_dir):
    return events(spark, sf_dir).persist()


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(*DOCUMENTS)


def _profiled(source: str, columns: list[str]) -> str:
    return f"SELECT '{source}' AS dataset, col AS \"column\", n - v AS null_count, u AS unique_count FROM ({q.column_facts(source, columns)})"


@register("profile_columns", ("dirty_customers", "line_facts"), q.union([_profiled("dirty_customers", CONTACTS), _profiled("line_facts", LINES), _profiled("documents", DOCUMENTS)]))
def profile_columns(spark, sf_dir):
    tables = {"dirty_customers": contacts, "line_facts": lines, "documents": documents}
    return reduce(
        DataFrame.unionByName,
        [profile.profile_columns(read(spark, sf_dir)).withColumn("dataset", F.lit(name)) for name, read in tables.items()],
    )


@register("profile_numeric", ("line_facts",), q.union([f"""
SELECT '{c}' AS "column", COUNT({c}) AS count, CAST(MIN({c}) AS DOUBLE) AS min, CAST(MAX({c}) AS DOUBLE) AS max,
  CAST(SUM({c}) AS DOUBLE) AS sum, CAST(SUM({c}) AS DOUBLE) / COUNT({c}) AS mean,
  {q.at_index(c, 'n // 2', 'line_facts')} AS median FROM line_facts""" for c in MEASURES]))
def profile_numeric(spark, sf_dir):
    return profile.numeric_profile(kept_lines(spark, sf_dir), MEASURES)


@register("upper_median", ("event_facts",), q.union([f"""
SELECT '{c}' AS "column", COUNT({c}) AS n, {q.at_index(c, 'n // 4', 'event_facts')} AS q1,
  {q.at_index(c, 'n // 2', 'event_facts')} AS median, {q.at_index(c, '(3 * n) // 4', 'event_facts')} AS q3 FROM event_facts""" for c in ("value", "user_id", "event_id")]))
def upper_median_query(spark, sf_dir):
    df = kept_events(spark, sf_dir)
    names = ["value", "user_id", "event_id"]
    stats = order_statistics(df, {c: col_of(c) for c in names}, {"q1": lower_quartile, "median": upper_median, "q3": upper_quartile})
    rows = [(c, s["n"], *(float(s[p]) for p in ("q1", "median", "q3"))) for c, s in stats.items()]
    return spark.createDataFrame(rows, "column string, n bigint, q1 double, median double, q3 double")


@register("profile_top_values", ("line_facts",), f"""
SELECT "column", CAST(rank AS INTEGER) AS rank, value, count FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({q.frequencies('line_facts', LINES)}))
WHERE rank <= 20""")
def profile_top_values(spark, sf_dir):
    return profile.top_values(lines(spark, sf_dir))


SAMPLED = ["ship_date", "return_flag", "quantity", "price"]
LINE_ORDER = ["order_no", "_part", "_supp"]


@register("profile_samples", ("line_facts",), q.union([f"""
SELECT * FROM (SELECT '{c}' AS "column", CAST(row_number() OVER (ORDER BY order_no, _part, _supp, CAST({c} AS VARCHAR)) AS INTEGER) AS position, CAST({c} AS VARCHAR) AS value
  FROM line_facts WHERE NOT {q.missing(c)}) WHERE position <= 5""" for c in SAMPLED]))
def profile_samples(spark, sf_dir):
    df = view(spark, sf_dir, "line_facts")
    return profile.first_values(df, LINE_ORDER, SAMPLED)


def _typed(source: str, columns: list[str]) -> str:
    return f"SELECT '{source}' AS dataset, * FROM ({q.column_types(source, columns)})"


@register("detect_column_types", ("event_facts", "line_facts", "dirty_customers"), q.union(
    [_typed("event_facts", EVENTS), _typed("line_facts", LINES), _typed("dirty_customers", CONTACTS), _typed("documents", DOCUMENTS)]))
def detect_column_types(spark, sf_dir):
    tables = {"event_facts": events, "line_facts": lines, "dirty_customers": contacts, "documents": documents}
    return reduce(
        DataFrame.unionByName,
        [profile.detect_column_types(read(spark, sf_dir)).withColumn("dataset", F.lit(name)) for name, read in tables.items()],
    )


def _filters(source: str, columns: list[str]) -> str:
    labels = {c: " ".join(w[:1].upper() + w[1:] for w in c.split("_")) for c in columns}
    label = "CASE \"column\" " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in labels.items()) + " END"
    return f"""
SELECT '{source}' AS dataset, "column", {label} AS label, value, count FROM (
  SELECT f.*, COUNT(*) OVER (PARTITION BY f."column") AS usable, dense_rank() OVER (ORDER BY t.position) AS place FROM (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({q.frequencies(source, columns)}))
    WHERE rank <= 20 AND LENGTH(value) >= 2 AND NOT regexp_matches(value, '^\\d+[/.\\\\]?$')) f
  JOIN ({q.column_types(source, columns)}) t ON t."column" = f."column" AND t.type = 'categorical' AND t.unique_count BETWEEN 2 AND 50
) WHERE usable >= 2 AND place <= 5"""


@register("filter_options", ("event_facts", "dirty_customers"), q.union([_filters("event_facts", EVENTS), _filters("dirty_customers", CONTACTS), _filters("documents", DOCUMENTS)]))
def filter_options(spark, sf_dir):
    tables = {"event_facts": events, "dirty_customers": contacts, "documents": documents}
    return reduce(
        DataFrame.unionByName,
        [profile.filter_options(read(spark, sf_dir)).withColumn("dataset", F.lit(name)) for name, read in tables.items()],
    )


def _context(source: str, columns: list[str], title: str) -> str:
    from ..operators.profile import DOMAINS

    words = f"{title} {' '.join(columns)}"
    domain = "CASE " + " ".join(f"WHEN regexp_matches(lower('{words}'), '{p}') THEN '{s}'" for p, s in DOMAINS) + " END"
    ranges = "CASE col " + " ".join(f"WHEN '{c}' THEN (SELECT {q.large_number(f'MIN({c})')} || ' – ' || {q.large_number(f'MAX({c})')} FROM {source})" for c in columns if c not in ("event_day", "event_type", "ship_date", "return_flag", "line_status")) + " END"
    return f"""
SELECT '{title}' AS dataset, concat_ws(' ', {domain}, (
  SELECT 'Note: columns ' || string_agg('"' || col || '" (numeric, range: ' || {ranges} || ')', ', ' ORDER BY position) || ' may have abbreviated names from the source file.'
  FROM (SELECT position, "column" AS col FROM ({q.column_types(source, columns)}) WHERE type = 'numeric'
    AND regexp_matches("column", '(?i)amount|^(value|amount|category|label)\\s*\\d*$|^.{{1,3}}$') ORDER BY position LIMIT 3))) AS context"""


@register("dataset_context", ("event_facts", "line_facts"), q.union([_context("event_facts", EVENTS, "Event Facts"), _context("line_facts", LINES, "Sales Lines")]))
def dataset_context(spark, sf_dir):
    return profile.dataset_context(kept_events(spark, sf_dir), "Event Facts").unionByName(
        profile.dataset_context(kept_lines(spark, sf_dir), "Sales Lines")
    )
