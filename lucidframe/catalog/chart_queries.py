"""Charts, KPIs, insights and summaries over standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import format_large_number
from ..operators import charts as ch
from ..operators import facts as fx
from ..operators import insights as ins
from ..operators import profile as prof
from ..plans.analyzer import analyze, analyze_selected
from . import sql_text as q
from .profile_queries import EVENTS, LINES, events, kept_events, kept_lines, lines
from .registry import register, view
from .views import read

LINE = ("line_facts",)
EVENT = ("event_facts",)
EVENT_SUMS = "g AS (SELECT event_type AS name, CAST(SUM(value) AS DOUBLE) AS total, COUNT(*) AS count FROM event_facts WHERE trim(event_type) <> '' GROUP BY 1)"
DAY_SUMS = "g AS (SELECT CAST(event_day AS VARCHAR) AS period, CAST(SUM(value) AS DOUBLE) AS total FROM event_facts GROUP BY 1)"
RANKED = """r AS (SELECT *, row_number() OVER (ORDER BY total DESC, name) AS up, row_number() OVER (ORDER BY total, name DESC) AS down FROM g),
  t AS (SELECT COUNT(*) AS n, CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS total FROM g)"""


def event_groups(spark, sf_dir):
    return fx.category_groups(events(spark, sf_dir), "event_type", "value")


def event_series(spark, sf_dir):
    return fx.series_facts(fx.time_groups(events(spark, sf_dir), "event_day", "value"))


def user_groups(spark, sf_dir):
    """Groups whose number grows with the data."""
    return fx.category_groups(events(spark, sf_dir), "user_id", "value")


USER_SUMS = "g AS (SELECT CAST(user_id AS VARCHAR) AS name, CAST(SUM(value) AS DOUBLE) AS total, COUNT(*) AS count FROM event_facts GROUP BY 1)"


@register("group_sum_top30", LINE, """
SELECT CAST(ship_date AS VARCHAR) AS ship_date, CAST(SUM(price) AS DOUBLE) AS price, CAST(SUM(quantity) AS DOUBLE) AS quantity
FROM line_facts GROUP BY 1 ORDER BY price DESC, ship_date LIMIT 30""")
def group_sum_top30(spark, sf_dir):
    return ch.largest_groups(lines(spark, sf_dir), "ship_date", ["price", "quantity"])


@register("time_series_sums", LINE, """
SELECT CAST(ship_date AS VARCHAR) AS ship_date, CAST(SUM(quantity) AS DOUBLE) AS quantity, CAST(SUM(discount) AS DOUBLE) AS discount, CAST(SUM(tax) AS DOUBLE) AS tax
FROM line_facts GROUP BY 1 ORDER BY 1""")
def time_series_sums(spark, sf_dir):
    return ch.time_series(lines(spark, sf_dir), "ship_date", ["quantity", "discount", "tax"])


@register("bar_by_category", EVENT, "SELECT event_type, CAST(SUM(value) AS DOUBLE) AS value FROM event_facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def bar_by_category(spark, sf_dir):
    return ch.largest_groups(events(spark, sf_dir), "event_type", ["value"])


@register("pie_share", EVENT, f"WITH {EVENT_SUMS}, {RANKED} SELECT name, g.total AS value, ROUND(g.total / t.total, 6) AS share FROM g, t")
def pie_share(spark, sf_dir):
    groups = ch.largest_groups(events(spark, sf_dir), "event_type", ["value"])
    return ch.shares(groups, "event_type", "value").withColumn("share", F.round("share", 6))


@register("pie_share_of_all", EVENT, f"WITH {USER_SUMS} SELECT name, total AS value, ROUND(total / (SELECT SUM(total) FROM g), 6) AS share FROM g ORDER BY total DESC, name LIMIT 30")
def pie_share_of_all(spark, sf_dir):
    """The largest of many groups, each as a part of the total of all."""
    df = events(spark, sf_dir)
    groups = ch.largest_groups(df, "user_id", ["value"])
    return ch.shares(groups, "user_id", "value", ch.group_sums(df, "user_id", ["value"])).withColumn("share", F.round("share", 6))


@register("pie_record_counts", (), "SELECT source AS name, COUNT(*) AS value FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def pie_record_counts(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    return ch.record_counts(documents, "source", ch.PIE_RECORDS)


@register("bar_second_category", LINE, "SELECT line_status, CAST(SUM(discount) AS DOUBLE) AS discount FROM line_facts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def bar_second_category(spark, sf_dir):
    return ch.largest_groups(lines(spark, sf_dir), "line_status", ["discount"])


@register("area_over_time", LINE, "SELECT CAST(ship_date AS VARCHAR) AS ship_date, CAST(SUM(discount) AS DOUBLE) AS discount FROM line_facts GROUP BY 1 ORDER BY 1")
def area_over_time(spark, sf_dir):
    return ch.time_series(lines(spark, sf_dir), "ship_date", ["discount"])


@register("scatter_points", LINE, """
SELECT x, y FROM (SELECT CAST(quantity AS DOUBLE) AS x, CAST(discount AS DOUBLE) AS y, row_number() OVER (ORDER BY order_no, _part, _supp, quantity, discount) AS i
  FROM line_facts WHERE quantity IS NOT NULL AND discount IS NOT NULL) WHERE i <= 200""")
def scatter_points(spark, sf_dir):
    return ch.scatter_points(view(spark, sf_dir, "line_facts"), "quantity", "discount", ["order_no", "_part", "_supp"])


_STRENGTH = "CASE WHEN ABS(r) > 0.7 THEN 'strong' WHEN ABS(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 THEN 'negative' ELSE 'no' END AS direction"


@register("pearson_strength", LINE, q.union([f"""
SELECT '{x} {y}' AS measures, pairs, ROUND(r, 6) AS r, {_STRENGTH} FROM (
  SELECT COUNT(*) AS pairs, corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE)) AS r FROM line_facts)""" for x, y in (("quantity", "price"), ("discount", "tax"))]))
def pearson_strength(spark, sf_dir):
    def one(x, y):
        found = ch.pearson(lines(spark, sf_dir), x, y)
        return found.select(F.lit(f"{x} {y}").alias("measures"), "pairs", F.round("r", 6).alias("r"), "strength", "direction")

    return one("quantity", "price").unionByName(one("discount", "tax"))


@register("records_by_category", (), "SELECT source AS name, COUNT(*) AS value FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def records_by_category(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    return ch.record_counts(documents, "source", ch.BARS)


def _kpis(source: str) -> str:
    """KPI rows of an event table, from its detected types."""
    return f"""ty AS ({q.column_types(source, EVENTS)}),
  sums AS (SELECT 'value' AS c, 'Value' AS label, CAST(SUM(value) AS DOUBLE) AS total, COUNT(value) AS k, CAST(MAX(value) AS DOUBLE) AS top FROM {source}
    UNION ALL SELECT 'user_id', 'User Id', CAST(SUM(user_id) AS DOUBLE), COUNT(user_id), CAST(MAX(user_id) AS DOUBLE) FROM {source}),
  main AS (SELECT sums.*, row_number() OVER (ORDER BY total DESC) AS place FROM sums JOIN ty ON ty."column" = sums.c WHERE type = 'numeric' AND total > 0),
  cats AS (SELECT * FROM ty WHERE type = 'categorical' ORDER BY position LIMIT 1),
  items AS (
    SELECT 0 AS p, 'Total Records' AS label, CAST(COUNT(*) AS DOUBLE) AS raw_value, trim(format('{{:,}}', COUNT(*))) AS value FROM {source}
    UNION ALL SELECT place, 'Total ' || label, total, {q.large_number('total')} FROM main WHERE place <= 2
    UNION ALL SELECT 3, 'Avg ' || label, total / k, {q.large_number('total / k')} FROM main WHERE place = 1
    UNION ALL SELECT 4, 'Event Type Groups', unique_count, CAST(unique_count AS VARCHAR) FROM cats
    UNION ALL SELECT 5, 'Highest ' || label, top, {q.large_number('top')} FROM main WHERE place = 1 AND top <> total)
SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS position, label, raw_value, value FROM items) WHERE position < 5"""


@register("kpi_standard", EVENT, "WITH " + _kpis("event_facts"))
def kpi_standard(spark, sf_dir):
    df = kept_events(spark, sf_dir)
    return ins.standard_kpis(spark, prof.profile(df))


@register("chart_recommendations", EVENT + LINE, f"""
WITH et AS ({q.column_types('event_facts', EVENTS)}), lt AS ({q.column_types('line_facts', LINES)}),
  types AS (SELECT 'event_facts' AS dataset, * FROM et UNION ALL SELECT 'line_facts', * FROM lt),
  named AS (SELECT *, array_to_string(list_transform(string_split("column", '_'), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS label FROM types),
  nums AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY position) AS k FROM named WHERE type = 'numeric'),
  cats AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY position) AS k FROM named WHERE type = 'categorical' AND unique_count BETWEEN 2 AND 30),
  times AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY position) AS k FROM named WHERE type = 'temporal'),
  found AS (
    SELECT t.dataset, 1 AS p, 'line' AS kind, n.label || ' Over ' || t.label AS title, t."column" AS x,
      (SELECT string_agg("column", ', ' ORDER BY k) FROM nums m WHERE m.dataset = t.dataset AND m.k <= 3) AS y
    FROM times t JOIN nums n ON n.dataset = t.dataset AND n.k = 1 WHERE t.k = 1 AND t.unique_count > 1
    UNION ALL SELECT c.dataset, 2, CASE WHEN c.unique_count > 8 THEN 'horizontal-bar' ELSE 'bar' END, n.label || ' by ' || c.label, c."column", n."column"
    FROM cats c JOIN nums n ON n.dataset = c.dataset AND n.k = 1 WHERE c.k = 1
    UNION ALL SELECT c.dataset, 3, 'pie', n.label || ' Share by ' || c.label, c."column", n."column"
    FROM cats c JOIN nums n ON n.dataset = c.dataset AND n.k = 1 WHERE c.k = 1 AND c.unique_count <= 10
    UNION ALL SELECT c.dataset, 4, CASE WHEN c.unique_count > 8 THEN 'horizontal-bar' ELSE 'bar' END, n.label || ' by ' || c.label, c."column", n."column"
    FROM cats c JOIN nums n ON n.dataset = c.dataset AND n.k = 2 WHERE c.k = 2
    UNION ALL SELECT t.dataset, 5, 'area', n.label || ' Trend', t."column", n."column"
    FROM times t JOIN nums n ON n.dataset = t.dataset AND n.k = 2 WHERE t.k = 1 AND t.unique_count > 1
    UNION ALL SELECT a.dataset, 6, 'scatter', a.label || ' vs ' || b.label, a."column", b."column"
    FROM nums a JOIN nums b ON a.dataset = b.dataset AND a.k = 1 AND b.k = 2)
SELECT dataset, CAST(row_number() OVER (PARTITION BY dataset ORDER BY p) - 1 AS INTEGER) AS position, kind, title, x, y FROM found""")
def chart_recommendations(spark, sf_dir):
    def one(name, df):
        return ch.chart_table(df, ch.recommend_charts(df, prof.profile(df))).withColumn("dataset", F.lit(name))

    return one("event_facts", kept_events(spark, sf_dir)).unionByName(one("line_facts", kept_lines(spark, sf_dir)))


@register("insight_leader", EVENT, f"""
WITH {EVENT_SUMS}, {RANKED} SELECT n AS groups, t.total, name, r.total AS value, count AS records,
  ROUND(r.total / t.total * 100, 6) AS share_pct, ROUND(r.total / count, 6) AS average FROM r, t WHERE up = 1 AND n >= 2""")
def insight_leader(spark, sf_dir):
    found = ins.leader(fx.group_facts(event_groups(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 6) for c in ("share_pct", "average")})


@register("insight_bottom", EVENT, f"""
WITH {EVENT_SUMS}, {RANKED} SELECT b.name, b.total AS value, b.count AS records,
  ROUND(CASE WHEN b.total > 0 AND a.total / b.total > 2 THEN a.total / b.total END, 6) AS times_less
FROM r b, r a, t WHERE b.down = 1 AND a.up = 1 AND n >= 2""")
def insight_bottom(spark, sf_dir):
    return ins.bottom(fx.group_facts(event_groups(spark, sf_dir))).withColumn("times_less", F.round("times_less", 6))


@register("insight_concentration", EVENT, f"""
WITH {EVENT_SUMS}, {RANKED}, three AS (SELECT CAST(SUM(CAST(total AS DECIMAL(28,2))) AS DOUBLE) AS s FROM r WHERE up <= 3)
SELECT n AS groups, s AS top3_total, t.total, ROUND(s / t.total * 100, 6) AS share_pct, s / t.total * 100 > 50 AS high FROM t, three WHERE n >= 5""")
def insight_concentration(spark, sf_dir):
    found = ins.concentration(fx.group_facts(event_groups(spark, sf_dir)))
    return found.withColumns({"top3_total": F.col("top3_total").cast("double"), "share_pct": F.round("share_pct", 6)})


@register("insight_group_skew", EVENT, f"""
WITH {USER_SUMS}, {RANKED} SELECT n AS groups, a.total AS top_total, ROUND(t.total / n, 6) AS mean, m.total AS median,
  a.total > t.total / n * 3 AND m.total < t.total / n AS skewed
FROM t, r a, r m WHERE a.up = 1 AND m.up = n // 2 + 1 AND n >= 4""")
def insight_group_skew(spark, sf_dir):
    groups = user_groups(spark, sf_dir)
    return ins.group_skew(fx.group_facts(groups), fx.group_median(groups)).withColumn("mean", F.round("mean", 6))


_ENDS = """f AS (SELECT * FROM g ORDER BY period LIMIT 1), l AS (SELECT * FROM g ORDER BY period DESC LIMIT 1),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY period DESC) AS i FROM g) WHERE i = 2), k AS (SELECT COUNT(*) AS n FROM g),
  hi AS (SELECT * FROM g ORDER BY total DESC, period LIMIT 1)"""


@register("insight_growth", EVENT, f"""
WITH {DAY_SUMS}, {_ENDS} SELECT n AS periods, f.period AS first_period, f.total AS first_total, l.period AS last_period, l.total AS last_total,
  ROUND((l.total - f.total) / f.total * 100, 6) AS growth_pct, CASE WHEN n >= 5 THEN 'high' ELSE 'medium' END AS confidence
FROM f, l, k WHERE n >= 2 AND f.total > 0""")
def insight_growth(spark, sf_dir):
    return ins.overall_growth(event_series(spark, sf_dir)).withColumn("growth_pct", F.round("growth_pct", 6))


@register("insight_momentum", EVENT, f"""
WITH {DAY_SUMS}, {_ENDS} SELECT p.period AS prev_period, p.total AS prev_total, l.period AS last_period, l.total AS last_total,
  ROUND((l.total - p.total) / p.total * 100, 6) AS change_pct FROM p, l WHERE p.total > 0""")
def insight_momentum(spark, sf_dir):
    return ins.momentum(event_series(spark, sf_dir)).withColumn("change_pct", F.round("change_pct", 6))


@register("insight_peak", EVENT, f"""
WITH {DAY_SUMS}, {_ENDS} SELECT hi.period AS peak_period, hi.total AS peak_total, l.period AS last_period, l.total AS last_total,
  ROUND(CASE WHEN l.total < hi.total THEN (1 - l.total / hi.total) * 100 END, 6) AS below_peak_pct
FROM hi, l, f WHERE hi.period <> l.period AND hi.period <> f.period""")
def insight_peak(spark, sf_dir):
    return ins.peak(event_series(spark, sf_dir)).withColumn("below_peak_pct", F.round("below_peak_pct", 6))


@register("insight_extreme_range", EVENT, f"""
SELECT *, ROUND(max / mean, 6) AS times_mean FROM (
  SELECT 'value' AS "column", COUNT(value) AS count, CAST(MIN(value) AS DOUBLE) AS min, CAST(MAX(value) AS DOUBLE) AS max, CAST(SUM(value) AS DOUBLE) AS sum,
    CAST(SUM(value) AS DOUBLE) / COUNT(value) AS mean, {q.at_index('value', 'n // 2', 'event_facts')} AS median FROM event_facts
  UNION ALL SELECT 'user_id', COUNT(user_id), MIN(user_id), MAX(user_id), CAST(SUM(user_id) AS DOUBLE), CAST(SUM(user_id) AS DOUBLE) / COUNT(user_id),
    {q.at_index('user_id', 'n // 2', 'event_facts')} FROM event_facts)
WHERE mean > 0 AND max <> 0 AND max > mean * 5""")
def insight_extreme_range(spark, sf_dir):
    found = ins.extreme_range(prof.numeric_profile(kept_events(spark, sf_dir), ["value", "user_id"]))
    return found.withColumn("times_mean", F.round("times_mean", 6))


@register("executive_summary_facts", EVENT, f"""
WITH {EVENT_SUMS}, {RANKED}, d AS (SELECT CAST(event_day AS VARCHAR) AS period, CAST(SUM(value) AS DOUBLE) AS total FROM event_facts GROUP BY 1)
SELECT (SELECT COUNT(*) FROM event_facts) AS records, t.n AS groups, (SELECT COUNT(*) FROM d) AS periods, (SELECT MIN(period) FROM d) AS first_period, (SELECT MAX(period) FROM d) AS last_period,
  t.total AS total, (SELECT CAST(MIN(value) AS DOUBLE) FROM event_facts) AS least, (SELECT CAST(MAX(value) AS DOUBLE) FROM event_facts) AS greatest,
  t.total / (SELECT COUNT(value) FROM event_facts) AS mean, {q.at_index('value', 'n // 2', 'event_facts')} AS median,
  t.total / (SELECT COUNT(value) FROM event_facts) > 1.5 * {q.at_index('value', 'n // 2', 'event_facts')} AS right_skewed,
  a.name AS leader, ROUND(a.total / t.total * 100, 6) AS leader_share_pct,
  ROUND(((SELECT total FROM d ORDER BY period DESC LIMIT 1) / (SELECT total FROM d ORDER BY period LIMIT 1) - 1) * 100, 6) AS growth_pct
FROM t, r a WHERE a.up = 1""")
def executive_summary_facts(spark, sf_dir):
    df = kept_events(spark, sf_dir)
    measured = prof.numeric_profile(df, ["value"]).select(
        F.col("sum").alias("total"), F.col("min").alias("least"), F.col("max").alias("greatest"), "mean", "median", (F.col("mean") > 1.5 * F.col("median")).alias("right_skewed")
    )
    grouped = fx.group_facts(event_groups(spark, sf_dir)).select(
        "groups", F.col("top_name").alias("leader"), F.round(ins.share(F.col("top_total"), F.col("total")), 6).alias("leader_share_pct")
    )
    timed = event_series(spark, sf_dir).select(
        "periods", "first_period", "last_period", F.round((F.col("last_total") / F.col("first_total") - 1) * 100, 6).alias("growth_pct")
    )
    return fx.one_row(df.agg(F.count("*").alias("records")), measured, grouped, timed)


@register("insights_standard", EVENT, f"""
WITH ty AS ({q.column_types('event_facts', EVENTS)}), pick AS (SELECT "column" AS c FROM ty WHERE type = 'numeric' ORDER BY position LIMIT 1),
  g AS (SELECT event_type AS name, CAST(SUM(CASE WHEN (SELECT c FROM pick) = 'value' THEN CAST(value AS DECIMAL(18,2)) ELSE CAST(user_id AS DECIMAL(18,2)) END) AS DOUBLE) AS total, COUNT(*) AS count
    FROM event_facts WHERE trim(event_type) <> '' GROUP BY 1),
  {RANKED}, l AS (SELECT CASE c WHEN 'value' THEN 'value' ELSE 'user id' END AS what FROM pick),
  three AS (SELECT SUM(total) AS s, string_agg('"' || name || '"', ', ' ORDER BY up) AS names FROM r WHERE up <= 3)
SELECT 0 AS position, '"' || name || '" dominates ' || what || ' — accounting for ' || {q.large_number('r.total')} || ' (' || {q.fixed('r.total / t.total * 100', 0)} || '% of total ' || {q.large_number('t.total')}
  || '), averaging ' || {q.large_number('r.total / count')} || ' per record across ' || count || ' entries.' AS text, 'positive' AS type FROM r, t, l WHERE up = 1
UNION ALL SELECT 1, '"' || b.name || '" has the lowest ' || what || ' at ' || {q.large_number('b.total')} || ' (' || b.count || ' records)'
  || CASE WHEN a.total / b.total > 2 THEN ' — ' || {q.fixed('a.total / b.total', 0)} || 'x less than the top performer' ELSE '' END || '.', 'info' FROM r b, r a, l WHERE b.down = 1 AND a.up = 1
UNION ALL SELECT 2, 'High concentration: ' || names || ' together hold ' || {q.fixed('s / t.total * 100', 0)} || '% of total ' || what || ' (' || {q.large_number('s')} || ' of ' || {q.large_number('t.total')}
  || '). Remaining ' || (n - 3) || ' groups share the other ' || {q.fixed('100 - s / t.total * 100', 0)} || '%.', 'warning' FROM three, t, l WHERE n >= 5 AND s / t.total > 0.5""")
def insights_standard(spark, sf_dir):
    """The whole standard analysis; the wording of its category insights is compared."""
    rows = kept_events(spark, sf_dir)
    whole = analyze(rows, "event_facts", ["event_id"])
    whole.release()  # the insights are worked out by now
    rows.unpersist()
    return whole.insights.where(F.col("kind").isin("leader", "bottom", "concentration")).select("position", "text", "type")


@register("filtered_reanalysis", EVENT, "WITH f AS (SELECT * FROM event_facts WHERE event_type = 'purchase'), " + _kpis("f"))
def filtered_reanalysis(spark, sf_dir):
    rows = kept_events(spark, sf_dir)
    part = analyze_selected(rows, "event_facts", {"event_type": "purchase"}, ["event_id"])
    part.release()  # the KPIs are worked out by now
    rows.unpersist()
    return part.kpis


@register("format_large_number", LINE, f"""
WITH d AS (SELECT CAST(ship_date AS VARCHAR) AS ship_date, CAST(SUM(price) AS DOUBLE) AS total, CAST(SUM(discount) AS DOUBLE) AS discount FROM line_facts GROUP BY 1)
SELECT ship_date, total, {q.large_number('total')} AS label, {q.large_number('discount')} AS small_label,
  CASE WHEN total >= 1e9 THEN '₱' || {q.fixed('total / 1e9', 2)} || 'B' WHEN total >= 1e6 THEN '₱' || {q.fixed('total / 1e6', 1)} || 'M'
    WHEN total >= 1e3 THEN '₱' || {q.fixed('total / 1e3', 0)} || 'K' ELSE '₱' || {q.fixed('total', 0)} END AS currency_label
FROM d""")
def format_large_number_query(spark, sf_dir):
    sums = ch.group_sums(lines(spark, sf_dir), "ship_date", ["price", "discount"])
    return sums.select(
        "ship_date", F.col("price").alias("total"), format_large_number(F.col("price")).alias("label"),
        format_large_number(F.col("discount")).alias("small_label"), format_large_number(F.col("price"), "currency").alias("currency_label"),
    )
