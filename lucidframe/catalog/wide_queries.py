"""Queries over a wide table: one row per supplier, one column per year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import column_label_of, period_label
from ..operators import facts as fx
from ..operators import insights as ins
from ..operators import reshape as rs
from ..plans.analyzer import analyze
from . import sql_text as q
from .registry import register, view

WIDE = ("supplier_years",)
YEARS = [str(y) for y in range(1995, 2002)]
LATEST, PREVIOUS, FIRST = YEARS[-1], YEARS[-2], YEARS[0]
LONG_SQL = "long AS (" + q.union(
    [f"SELECT region, nation, supplier, '{y}' AS period, \"{y}\" AS value FROM supplier_years WHERE \"{y}\" <> 0" for y in YEARS]) + ")"
TOTALS_SQL = "totals AS (" + q.union(
    [f"SELECT {i} AS position, '{y}' AS period, CAST(COALESCE(SUM(\"{y}\"), 0) AS DOUBLE) AS total FROM supplier_years" for i, y in enumerate(YEARS)]) + ")"


def wide(spark, sf_dir):
    return view(spark, sf_dir, "supplier_years")


def facts(spark, sf_dir):
    df = wide(spark, sf_dir)
    periods = rs.period_columns(df.columns)
    return ins.wide_facts(rs.period_sums(df, periods), periods)


@register("wide_category_columns", WIDE, q.union([f"""
SELECT {i} AS position, '{c}' AS "column", COUNT({c}) AS filled, COUNT({q.number(c)}) AS numeric,
  AVG(LENGTH({c})) AS mean_length, COUNT({c}) > 0 AND COUNT({q.number(c)}) <= COUNT({c}) * 0.5 AND AVG(LENGTH({c})) >= 3 AS is_category
FROM supplier_years""" for i, c in enumerate(["region", "nation", "supplier"])]))
def wide_category_columns(spark, sf_dir):
    return rs.category_facts(wide(spark, sf_dir))


@register("unpivot_periods", WIDE, f"WITH {LONG_SQL} SELECT region, nation, supplier, period, CAST(value AS DOUBLE) AS value FROM long")
def unpivot_periods(spark, sf_dir):
    return rs.unpivot_periods(wide(spark, sf_dir)).withColumn("value", F.col("value").cast("double"))


@register("period_totals", WIDE, f"WITH {TOTALS_SQL} SELECT * FROM totals")
def period_totals(spark, sf_dir):
    return rs.period_totals(wide(spark, sf_dir))


def _latest(category: str) -> str:
    return f"""SELECT * FROM (SELECT {category} AS name, CAST(SUM(COALESCE("{LATEST}", 0)) AS DOUBLE) AS value FROM supplier_years GROUP BY 1)
    WHERE value <> 0 ORDER BY value DESC, name LIMIT 15"""


@register("latest_period_by_category", WIDE, _latest("region"))
def latest_period_by_category(spark, sf_dir):
    return rs.period_by_category(wide(spark, sf_dir), "region")


@register("latest_period_by_second_category", WIDE, _latest("nation"))
def latest_period_by_second_category(spark, sf_dir):
    return rs.period_by_category(wide(spark, sf_dir), "nation")


_SERIES = ", ".join(f'CAST(COALESCE(SUM("{y}"), 0) AS DOUBLE) AS "{y}"' for y in YEARS)


@register("multi_series_top5", WIDE, f"""
WITH best AS (SELECT nation AS series, {_SERIES} FROM supplier_years GROUP BY nation ORDER BY "{LATEST}" DESC, series LIMIT 5)
""" + q.union([f'SELECT {i} AS position, \'{y}\' AS period, series, "{y}" AS value FROM best' for i, y in enumerate(YEARS)]))
def multi_series_top5(spark, sf_dir):
    return rs.multi_series(wide(spark, sf_dir), "nation")


WIDE_FACTS_SQL = TOTALS_SQL + f""", base AS (SELECT
    (SELECT COUNT(*) FROM supplier_years) AS n,
    (SELECT SUM(CAST(total AS DECIMAL(28,2))) FROM totals)::DOUBLE AS grand,
    (SELECT total FROM totals WHERE period = '{LATEST}') AS latest,
    (SELECT total FROM totals WHERE period = '{PREVIOUS}') AS prev,
    (SELECT total FROM totals WHERE period = '{FIRST}') AS first)"""


@register("kpi_wide", WIDE, f"""
WITH {WIDE_FACTS_SQL}
SELECT 0 AS position, 'Latest Period ({LATEST})' AS label, {q.large_number('latest')} AS value, latest AS raw_value FROM base
UNION ALL SELECT 1, 'Grand Total', {q.large_number('grand')}, grand FROM base
UNION ALL SELECT 2, 'Period Average', {q.large_number('grand / 7')}, grand / 7 FROM base
UNION ALL SELECT 3, 'Growth ({PREVIOUS} → {LATEST})', CASE WHEN latest >= prev THEN '+' ELSE '' END || {q.fixed('(latest - prev) / prev * 100', 1)} || '%', (latest - prev) / prev * 100 FROM base WHERE prev > 0
UNION ALL SELECT 4, 'Distinct Region', CAST((SELECT COUNT(DISTINCT region) FROM supplier_years) AS VARCHAR), (SELECT COUNT(DISTINCT region) FROM supplier_years)""")
def kpi_wide(spark, sf_dir):
    regions = wide(spark, sf_dir).select("region").distinct().count()
    return ins.wide_kpis(spark, facts(spark, sf_dir).first(), "region", regions)


@register("cagr", WIDE, f"""
WITH {WIDE_FACTS_SQL} SELECT 7 AS periods, first AS first_total, latest AS latest_total,
  ROUND((POW(latest / first, 1.0 / 6) - 1) * 100, 6) AS cagr_pct FROM base WHERE first > 0 AND latest > 0""")
def cagr(spark, sf_dir):
    return facts(spark, sf_dir).where("cagr_pct IS NOT NULL").select("periods", "first_total", "latest_total", F.round("cagr_pct", 6).alias("cagr_pct"))


@register("insight_wide_growth", WIDE, f"""
WITH {WIDE_FACTS_SQL} SELECT '{PREVIOUS}' AS prev_period, prev AS prev_total, '{LATEST}' AS latest_period, latest AS latest_total,
  ROUND((latest - prev) / prev * 100, 6) AS change_pct FROM base WHERE prev > 0""")
def insight_wide_growth(spark, sf_dir):
    found = facts(spark, sf_dir).where("change_pct IS NOT NULL")
    return found.select("prev_period", "prev_total", "latest_period", "latest_total", F.round("change_pct", 6).alias("change_pct"))


@register("insight_wide_peak_low", WIDE, f"""
WITH {TOTALS_SQL}, hi AS (SELECT * FROM totals ORDER BY total DESC, position LIMIT 1), lo AS (SELECT * FROM totals ORDER BY total, position LIMIT 1)
SELECT hi.period AS peak_period, hi.total AS peak_total, lo.period AS low_period, lo.total AS low_total FROM hi, lo WHERE hi.period <> lo.period""")
def insight_wide_peak_low(spark, sf_dir):
    return facts(spark, sf_dir).where("peak_period <> low_period").select("peak_period", "peak_total", "low_period", "low_total")


@register("insight_wide_category", WIDE, f"""
WITH g AS (SELECT nation AS name, CAST(SUM(COALESCE("{LATEST}", 0)) AS DOUBLE) AS total FROM supplier_years GROUP BY 1),
  r AS (SELECT *, row_number() OVER (ORDER BY total DESC, name) AS up, row_number() OVER (ORDER BY total, name DESC) AS down FROM g),
  t AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM g),
  three AS (SELECT CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM r WHERE up <= 3)
SELECT t.n AS groups, a.name AS top_name, a.total AS top_total, ROUND(a.total / t.total * 100, 6) AS top_share_pct,
  b.name AS bottom_name, b.total AS bottom_total, ROUND(three.total / t.total * 100, 6) AS top3_share_pct
FROM t, three, r a, r b WHERE a.up = 1 AND b.down = 1""")
def insight_wide_category(spark, sf_dir):
    found = fx.group_facts(rs.category_totals(wide(spark, sf_dir), "nation", LATEST))
    return found.select(
        "groups", "top_name", "top_total", F.round(ins.share(F.col("top_total"), F.col("total")), 6).alias("top_share_pct"),
        "bottom_name", "bottom_total", F.round(ins.share(F.col("top3_total"), F.col("total")), 6).alias("top3_share_pct"),
    )


@register("executive_summary_wide_facts", WIDE, f"""
WITH {WIDE_FACTS_SQL} SELECT n AS rows, 7 AS periods, '{FIRST}' AS first_period, first AS first_total, '{LATEST}' AS latest_period, latest AS latest_total,
  grand AS grand_total, grand / 7 AS period_average, ROUND((latest / (grand / 7) - 1) * 100, 6) AS against_average_pct,
  ROUND((latest - first) / first * 100, 6) AS growth_pct, ROUND((latest - prev) / prev * 100, 6) AS change_pct FROM base""")
def executive_summary_wide_facts(spark, sf_dir):
    return facts(spark, sf_dir).select(
        "rows", "periods", "first_period", "first_total", "latest_period", "latest_total", "grand_total", "period_average",
        F.round((F.col("latest_total") / F.col("period_average") - 1) * 100, 6).alias("against_average_pct"),
        F.round("growth_pct", 6).alias("growth_pct"), F.round("change_pct", 6).alias("change_pct"),
    )


@register("period_label", ("sparse_orders",), """
SELECT label, column_label, COUNT(*) AS orders FROM (
  SELECT CAST(CAST(year(o_orderdate) AS INT) AS VARCHAR) || ' P' || CAST(CAST(month(o_orderdate) AS INT) AS VARCHAR) AS label,
    'Order ' || upper(left(o_orderstatus, 1)) || substr(lower(o_orderpriority), 2) AS column_label FROM orders
) GROUP BY 1, 2""".replace("'Order ' || upper(left(o_orderstatus, 1)) || substr(lower(o_orderpriority), 2)", "'Order Status ' || o_orderstatus"))
def period_label_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = F.concat_ws(" ", F.year("o_orderdate"), F.month("o_orderdate"))
    name = F.concat(F.lit("order_status-"), F.col("o_orderstatus"))
    labelled = orders.select(period_label(raw).alias("label"), column_label_of(name).alias("column_label"))
    return labelled.groupBy("label", "column_label").agg(F.count("*").alias("orders"))


@register("analyze_wide", WIDE, f"""
WITH {WIDE_FACTS_SQL}, g AS (SELECT region AS name, CAST(SUM(COALESCE("{LATEST}", 0)) AS DOUBLE) AS total FROM supplier_years GROUP BY 1),
  t AS (SELECT COUNT(*) AS k, CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM g),
  top AS (SELECT * FROM g ORDER BY total DESC, name LIMIT 1)
SELECT 'This analysis covers ' || n || ' records over 7 periods ({FIRST} to {LATEST}). The aggregate total across all periods is ' || {q.large_number('grand')}
  || ', averaging ' || {q.large_number('grand / 7')} || ' per period. The latest period ({LATEST}) totals ' || {q.large_number('latest')}
  || ' (' || CASE WHEN latest >= grand / 7 THEN '+' ELSE '' END || {q.fixed('(latest / (grand / 7) - 1) * 100', 0)} || '% vs. period average). From {FIRST} to {LATEST}, values '
  || CASE WHEN latest >= first THEN 'grew' ELSE 'declined' END || ' by ' || {q.fixed('ABS((latest - first) / first * 100)', 0)} || '% (' || {q.large_number('first')} || ' → ' || {q.large_number('latest')}
  || '). The most recent period-over-period change is ' || CASE WHEN latest >= prev THEN '+' ELSE '' END || {q.fixed('(latest - prev) / prev * 100', 1)} || '%. Among ' || t.k || ' region groups, "'
  || top.name || '" leads the latest period with ' || {q.large_number('top.total')} || ' (' || {q.fixed('top.total / t.total * 100', 0)} || '% share).' AS summary
FROM base, t, top""")
def analyze_wide(spark, sf_dir):
    """The whole wide analysis; its summary text is compared."""
    return analyze(wide(spark, sf_dir).persist(), "supplier_years").summary
