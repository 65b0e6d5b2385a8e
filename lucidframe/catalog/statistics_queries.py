"""Further statistics over the events and order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics as st
from . import sql_text as q
from .profile_queries import events, lines
from .registry import register
from .views import read

MEASURES = ["quantity", "discount", "price"]
ROUNDED = ["mean", "variance", "stddev", "range", "q1", "median", "q3", "mad", "skewness", "kurtosis", "variation", "mode", "entropy"]


def _described(c: str) -> str:
    """Moments written out; the order statistics by index into the sorted values."""
    at = lambda value, index, source: f"(SELECT {value} FROM (SELECT {value}, row_number() OVER (ORDER BY {value}) - 1 AS i FROM {source}) WHERE i = {index})"
    return f"""SELECT '{c}' AS "column", n, ROUND(m, 4) AS mean, ROUND(m2, 2) AS variance, ROUND(SQRT(m2), 4) AS stddev, ROUND(hi - lo, 4) AS range,
  ROUND(q1, 4) AS q1, ROUND(med, 4) AS median, ROUND(q3, 4) AS q3, ROUND(mad, 4) AS mad, ROUND(m3 / POW(m2, 1.5), 4) AS skewness, ROUND(m4 / POW(m2, 2) - 3, 4) AS kurtosis,
  ROUND(SQRT(m2) / m, 4) AS variation, ROUND(mode, 4) AS mode, ROUND(entropy, 4) AS entropy
FROM (WITH v AS (SELECT {c}::DOUBLE AS x FROM line_facts WHERE {c} IS NOT NULL), b AS (SELECT COUNT(*) AS n, AVG(x) AS m, MIN(x) AS lo, MAX(x) AS hi FROM v),
    o AS (SELECT {at('x', '(SELECT n // 4 FROM b)', 'v')} AS q1, {at('x', '(SELECT n // 2 FROM b)', 'v')} AS med, {at('x', '(SELECT 3 * n // 4 FROM b)', 'v')} AS q3),
    d AS (SELECT ABS(x - (SELECT med FROM o)) AS x FROM v), f AS (SELECT x, COUNT(*) AS k FROM v GROUP BY x)
  SELECT n, m, lo, hi, q1, med, q3, {at('x', '(SELECT n // 2 FROM b)', 'd')} AS mad, (SELECT AVG(POW(x - m, 2)) FROM v) AS m2, (SELECT AVG(POW(x - m, 3)) FROM v) AS m3,
    (SELECT AVG(POW(x - m, 4)) FROM v) AS m4, (SELECT x FROM f ORDER BY k DESC, x LIMIT 1) AS mode, (SELECT -SUM(k::DOUBLE / n * LN(k::DOUBLE / n)) FROM f) AS entropy FROM b, o)"""


@register("describe_measures", ("line_facts",), q.union([_described(c) for c in MEASURES]))
def describe_measures(spark, sf_dir):
    return st.describe(lines(spark, sf_dir), MEASURES).withColumns({c: F.round(c, 2 if c == "variance" else 4) for c in ROUNDED})


@register("histogram_price", ("line_facts",), """
SELECT CAST(CASE WHEN price < 0 THEN 0 WHEN price >= 50000 THEN 26 ELSE FLOOR(price::DOUBLE / 2000) + 1 END AS BIGINT) AS bin, COUNT(*) AS count
FROM line_facts WHERE price IS NOT NULL GROUP BY 1""")
def histogram_price(spark, sf_dir):
    return st.histogram(lines(spark, sf_dir), "price", 0, 50_000, 25)


_TABLE = "t AS (SELECT return_flag AS a, line_status AS b, COUNT(*) AS o FROM line_facts GROUP BY 1, 2)"


@register("category_association", ("line_facts",), f"""
WITH {_TABLE}, m AS (SELECT o, SUM(o) OVER (PARTITION BY a) AS r, SUM(o) OVER (PARTITION BY b) AS c FROM t),
  s AS (SELECT (SELECT SUM(o) FROM t) AS n, SUM(o * o::DOUBLE / (r * c)) AS t, (SELECT COUNT(DISTINCT a) FROM t) AS x, (SELECT COUNT(DISTINCT b) FROM t) AS y FROM m)
SELECT n::BIGINT AS n, ROUND(n * (t - 1), 4) AS chi_square, ((x - 1) * (y - 1))::BIGINT AS freedom, ROUND(SQRT((t - 1) / (LEAST(x, y) - 1)), 4) AS v FROM s""")
def category_association(spark, sf_dir):
    return st.association(lines(spark, sf_dir), "return_flag", "line_status").withColumns({"chi_square": F.round("chi_square", 4), "v": F.round("v", 4)})


@register("integrity_report", (), """
SELECT 'repeated order keys' AS rule, (SELECT COUNT(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1)) AS violations
UNION ALL SELECT 'lines without an order', (SELECT COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT 'events without a customer', (SELECT COUNT(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer))
UNION ALL SELECT 'positive quantity', (SELECT COUNT(*) FROM lineitem WHERE l_quantity <= 0)
UNION ALL SELECT 'discount below 5 %', (SELECT COUNT(*) FROM lineitem WHERE l_discount >= 0.05)""")
def integrity_report(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem")
    count = lambda name, df: df.agg(F.lit(name).alias("rule"), F.count("*").alias("violations"))
    rules = {"positive quantity": F.col("l_quantity") > 0, "discount below 5 %": F.col("l_discount") < 0.05}
    found = count("repeated order keys", st.repeated_keys(items, ["l_orderkey", "l_linenumber"]))
    found = found.unionByName(count("lines without an order", st.orphans(items, "l_orderkey", read(spark, sf_dir, "orders"), "o_orderkey")))
    found = found.unionByName(count("events without a customer", st.orphans(read(spark, sf_dir, "events"), "user_id", read(spark, sf_dir, "customer"), "c_custkey")))
    return found.unionByName(st.impossible_values(items, rules))


_SERIES = "s AS (SELECT event_type, event_day, CAST(SUM(value) AS DOUBLE) AS total FROM event_facts GROUP BY 1, 2)"


@register("rolling_week", ("event_facts",), f"""
WITH {_SERIES} SELECT event_type, event_day, total, ROUND(AVG(total) OVER (PARTITION BY event_type ORDER BY event_day ROWS 6 PRECEDING), 4) AS rolling FROM s""")
def rolling_week(spark, sf_dir):
    series = events(spark, sf_dir).groupBy("event_type", "event_day").agg(F.sum("value").cast("double").alias("total"))
    return st.rolling_average(series, "event_day", "total", 7, "event_type").withColumn("rolling", F.round("rolling", 4))


@register("autocorrelation_days", ("event_facts",), """
WITH s AS (SELECT event_day AS d, CAST(SUM(value) AS DOUBLE) AS x FROM event_facts GROUP BY 1), l AS (SELECT unnest([1, 7]) AS lag)
SELECT lag::INTEGER AS lag, COUNT(*) AS pairs, ROUND(CORR(a.x, b.x), 4) AS r FROM l, s a, s b WHERE a.d = b.d + lag::INTEGER GROUP BY lag""")
def autocorrelation_days(spark, sf_dir):
    series = events(spark, sf_dir).groupBy("event_day").agg(F.sum("value").alias("total"))
    return st.autocorrelation(series, "event_day", "total", [1, 7]).withColumn("r", F.round("r", 4))


@register("seasonality_months", ("line_facts",), """
SELECT month(ship_date)::INTEGER AS season, ROUND(AVG(price::DOUBLE) / (SELECT AVG(price::DOUBLE) FROM line_facts), 6) AS index FROM line_facts GROUP BY 1""")
def seasonality_months(spark, sf_dir):
    return st.seasonality(lines(spark, sf_dir), F.month("ship_date"), "price").withColumn("index", F.round("index", 6))


