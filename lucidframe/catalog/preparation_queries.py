"""Filling, rank and linear relations, semantic types, written dates, redundant columns and outliers."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import imputation, mixed_dates, moments, quality, redundancy, semantics
from ..operators import statistics as st
from . import sql_text as q
from .profile_queries import contacts, lines
from .registry import register, view

MEASURES = ["quantity", "price", "discount", "tax"]
_VALUE, _TAG = "CASE WHEN value IS NOT NULL THEN value END", "CASE WHEN tag IS NOT NULL AND tag <> '' THEN tag END"


def _carried(direction: str) -> str:
    over = f"OVER (PARTITION BY event_type ORDER BY event_id{direction} ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT event_id, event_type, LAST_VALUE({_VALUE} IGNORE NULLS) {over} AS value,
  COALESCE(LAST_VALUE({_TAG} IGNORE NULLS) {over}, tag) AS tag FROM sparse_events"""


# Five entities hold all events, so each is far larger than a task's share.
@register("impute_fill", ("sparse_events",), f"""
SELECT f.event_id, f.event_type, f.value, f.tag, b.value AS next_value, b.tag AS next_tag
FROM ({_carried("")}) f JOIN ({_carried(" DESC")}) b ON f.event_id = b.event_id""")
def impute_fill(spark, sf_dir):
    rows = view(spark, sf_dir, "sparse_events").select("event_id", "event_type", "value", "tag")
    both = rows.withColumns({"next_value": F.col("value"), "next_tag": F.col("tag")})
    ahead = imputation.carry(both, ["value", "tag"], ["event_type"], ["event_id"], ids=[])
    return imputation.carry(ahead, ["next_value", "next_tag"], ["event_type"], ["event_id"], backward=True, ids=[])


_GROUPED = """
WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, COUNT(*) OVER (PARTITION BY event_type) AS n FROM sparse_events WHERE value IS NOT NULL),
  med AS (SELECT event_type, value AS median FROM v WHERE i = n // 2),
  avgs AS (SELECT event_type, CAST(SUM(value) AS DOUBLE) / COUNT(value) AS mean FROM sparse_events GROUP BY 1),
  modes AS (SELECT event_type, tag AS mode FROM (SELECT event_type, tag, COUNT(*) AS k FROM sparse_events WHERE tag <> '' GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY k DESC, tag) = 1)
SELECT event_id, event_type, COALESCE(value, median) AS value, ROUND(COALESCE(CAST(value AS DOUBLE), mean), 6) AS mean_value,
  CASE WHEN tag IS NULL OR tag = '' THEN mode ELSE tag END AS tag
FROM sparse_events JOIN med USING (event_type) JOIN avgs USING (event_type) JOIN modes USING (event_type)"""


@register("impute_groups", ("sparse_events",), _GROUPED)
def impute_groups(spark, sf_dir):
    rows = view(spark, sf_dir, "sparse_events").select("event_id", "event_type", "value", F.col("value").alias("mean_value"), "tag")
    filled = imputation.fill_by_group(rows, {"value": "median", "mean_value": "mean", "tag": "mode"}, ["event_type"])
    return filled.withColumn("mean_value", F.round("mean_value", 6))


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


@register("spearman_strength", ("line_facts",), f"WITH r AS (SELECT {', '.join(_rank(c) for c in MEASURES)} FROM line_facts) " + q.union(
    [f"SELECT '{a}' AS first, '{b}' AS second, COUNT(*) AS n, ROUND(CORR({a}, {b}), 6) AS r FROM r" for a, b in combinations(MEASURES, 2)]))
def spearman_strength(spark, sf_dir):
    return moments.spearman(lines(spark, sf_dir), MEASURES).withColumn("r", F.round("r", 6))


WIDE = ["2_quantity", "price", "discount", "tax", "gap", "flat"]
_WIDE_SQL = """w AS (SELECT quantity::DOUBLE AS "2_quantity", price::DOUBLE AS price, discount::DOUBLE AS discount, tax::DOUBLE AS tax,
  CASE WHEN order_no % 3 = 0 THEN NULL ELSE (quantity * price)::DOUBLE END AS gap, 7.0::DOUBLE AS flat FROM line_facts)"""


def _wide(spark, sf_dir):
    rows = lines(spark, sf_dir)
    gap = F.when(F.col("order_no") % 3 != 0, F.col("quantity") * F.col("price"))
    return rows.select(F.col("quantity").alias("2_quantity"), "price", "discount", "tax", gap.alias("gap"), F.lit(7.0).alias("flat"))


def _r(a: str, b: str) -> str:
    n = f'COUNT(*) FILTER (WHERE "{a}" IS NOT NULL AND "{b}" IS NOT NULL)'
    r = "NULL::DOUBLE" if "flat" in (a, b) else f'ROUND(CORR("{a}", "{b}"), 6)'
    return f"SELECT '{a}' AS first, '{b}' AS second, {n} AS n, {r} AS r FROM w"


@register("correlation_matrix", ("line_facts",), f"WITH {_WIDE_SQL} " + q.union([_r(a, b) for a in WIDE for b in WIDE]))
def correlation_matrix(spark, sf_dir):
    return moments.correlation_matrix(_wide(spark, sf_dir), WIDE).withColumn("r", F.round("r", 6))


@register("linear_fit", ("line_facts",), """
WITH f AS (SELECT price::DOUBLE AS y, quantity::DOUBLE AS a, discount::DOUBLE AS b FROM line_facts),
  m AS (SELECT COUNT(*) AS n, AVG(y) AS y, AVG(a) AS a, AVG(b) AS b, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, y) AS ay, COVAR_POP(b, y) AS by_, VAR_POP(y) AS yy FROM f),
  s AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m)
SELECT n, ROUND(y - p * a - q * b, 4) AS intercept, ROUND(p, 4) AS quantity, ROUND(q, 4) AS discount,
  ROUND((p * ay + q * by_) / yy, 6) AS r_squared, ROUND(SQRT(yy - p * ay - q * by_), 4) AS rmse FROM s""")
def linear_fit(spark, sf_dir):
    fit = moments.linear_fit(lines(spark, sf_dir), "price", ["quantity", "discount"])
    row = (fit.n, round(fit.intercept, 4), *(round(b, 4) for b in fit.coefficients), round(fit.r_squared, 6), round(fit.rmse, 4))
    return spark.createDataFrame([row], "n long, intercept double, quantity double, discount double, r_squared double, rmse double")


CARDS = ["order_no", "mail", "telephone", "page", "token", "card", "place", "amount", "share", "agreed", "mixed", "consent", "order_text", "nothing", "channel", "unit", "status"]
_DIGIT = "CAST(reverse(digits)[i] AS INTEGER)"
_LUHN = f"list_sum(list_transform(range(1, len(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN 2 * {_DIGIT} - 9 ELSE 2 * {_DIGIT} END)) % 10 = 0"
_KINDS = {
    "uuid": f"regexp_matches(t, '{semantics.UUID}')",
    "email": f"regexp_matches(t, '{semantics.EMAIL}')",
    "url": f"regexp_matches(t, '{semantics.URL}')",
    "ip_address": f"regexp_matches(t, '{semantics.IPV4}')",
    "card_number": f"CASE WHEN regexp_matches(t, '{semantics.CARD}') AND len(digits) BETWEEN 13 AND 19 THEN {_LUHN} ELSE FALSE END",
    "coordinates": f"CASE WHEN regexp_matches(t, '{semantics.COORDINATES}') THEN ABS(TRY_CAST(regexp_extract(t, '^[^,;]+') AS DOUBLE)) <= 90 AND ABS(TRY_CAST(trim(regexp_extract(t, '[,;](.*)$', 1)) AS DOUBLE)) <= 180 ELSE FALSE END",
    "date": r"TRY_CAST(regexp_extract(replace(t, '/', '-'), '^(\d{4}-\d{1,2}-\d{1,2})([ T].*)?$', 1) AS DATE) IS NOT NULL",
    "phone": f"regexp_matches(t, '{semantics.PHONE}') AND len(digits) BETWEEN 7 AND 15",
    "currency": f"regexp_matches(t, '{semantics.CURRENCY}')",
    "percent": f"regexp_matches(t, '{semantics.PERCENT}')",
    "boolean": "lower(t) IN ('true', 'false', 'yes', 'no', 'y', 'n')",
}


def _semantic_sql() -> str:
    cells = q.union([f"SELECT '{c}' AS col, {q.strip(f'CAST({c} AS VARCHAR)')} AS t FROM contact_cards" for c in CARDS])
    counts = ", ".join(f"COUNT(*) FILTER (WHERE {passes}) AS {kind}" for kind, passes in _KINDS.items())
    votes = ", ".join(f"{{'m': {kind}, 'o': {-i}, 'k': '{kind}'}}" for i, kind in enumerate(_KINDS))
    return f"""WITH cells AS ({cells}), d AS (SELECT col, t, regexp_replace(t, '\\D', '', 'g') AS digits FROM cells WHERE t <> ''),
  c AS (SELECT col, COUNT(*) AS filled, {counts} FROM d GROUP BY col), b AS (SELECT col, filled, list_max([{votes}]) AS best FROM c),
  r AS (SELECT *, best.m / filled AS rate, CASE WHEN best.m >= 0.95 * filled THEN 'high' WHEN best.m >= 0.8 * filled THEN 'medium' WHEN best.m >= 0.5 * filled THEN 'low' END AS confidence FROM b)
SELECT n.col AS "column", COALESCE(filled, 0) AS filled, CASE WHEN confidence IS NULL THEN 'text' ELSE best.k END AS semantic_type, COALESCE(best.m, 0) AS matching, ROUND(rate, 6) AS rate, confidence
FROM (SELECT unnest({CARDS}) AS col) n LEFT JOIN r ON n.col = r.col"""


@register("semantic_types", ("contact_cards",), _semantic_sql())
def semantic_types(spark, sf_dir):
    return semantics.semantic_types(view(spark, sf_dir, "contact_cards"), CARDS).withColumn("rate", F.round("rate", 6))


_MONTH = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(substr({}, 1, 3)))"


def _date_sql(c: str) -> str:
    day = lambda y, m, d: f"TRY_CAST({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
    part = lambda p, i: f"regexp_extract({c}, '{p}', {i})"
    n = mixed_dates.NUMBERS
    a, b, y = part(n, 1), part(n, 2), part(n, 3)
    ai, bi = f"TRY_CAST({a} AS INTEGER)", f"TRY_CAST({b} AS INTEGER)"
    votes = f"(SELECT COUNT(*) FILTER (WHERE {ai} BETWEEN 13 AND 31 AND {bi} BETWEEN 1 AND 12) - COUNT(*) FILTER (WHERE {bi} BETWEEN 13 AND 31 AND {ai} BETWEEN 1 AND 12) FROM written_dates)"
    numbers = f"CASE WHEN {ai} > 12 THEN {day(y, b, a)} WHEN {bi} > 12 THEN {day(y, a, b)} WHEN {votes} > 0 THEN {day(y, b, a)} ELSE {day(y, a, b)} END"
    month = lambda p, i: f"CAST({_MONTH.format(part(p, i))} AS VARCHAR)"
    forms = [
        (mixed_dates.YEAR_FIRST, day(*(part(mixed_dates.YEAR_FIRST, i) for i in (1, 2, 3)))), (mixed_dates.COMPACT, day(*(part(mixed_dates.COMPACT, i) for i in (1, 2, 3)))), (n, numbers),
        (mixed_dates.DAY_NAME, day(part(mixed_dates.DAY_NAME, 3), month(mixed_dates.DAY_NAME, 2), part(mixed_dates.DAY_NAME, 1))),
        (mixed_dates.NAME_DAY, day(part(mixed_dates.NAME_DAY, 3), month(mixed_dates.NAME_DAY, 1), part(mixed_dates.NAME_DAY, 2))),
    ]
    value = "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN {v}" for p, v in forms) + " END"
    known = " OR ".join(f"regexp_matches({c}, '{p}')" for p, _ in forms)
    status = f"""CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 'missing' WHEN NOT ({known}) THEN 'unknown' WHEN ({value}) IS NULL THEN 'invalid'
      WHEN {votes} = 0 AND {ai} <= 12 AND {bi} <= 12 AND {ai} <> {bi} THEN 'ambiguous' ELSE 'parsed' END"""
    return f"{value} AS {c}_date, {status} AS {c}_status"


DATES = ["ordered", "shipped", "billed"]


@register("parse_dates", ("written_dates",), f"SELECT order_no, {', '.join(DATES)}, {', '.join(_date_sql(c) for c in DATES)} FROM written_dates")
def parse_dates(spark, sf_dir):
    return mixed_dates.parse_dates(view(spark, sf_dir, "written_dates"), DATES)


def _same(a: str, b: str) -> str:
    return f"SELECT '{b}' AS \"column\", '{a}' AS duplicate_of FROM contact_cards HAVING COUNT(*) FILTER (WHERE CAST({a} AS VARCHAR) IS DISTINCT FROM CAST({b} AS VARCHAR)) = 0"


@register("duplicate_columns", ("contact_cards",), q.union([_same(a, b) for a, b in combinations(CARDS, 2)]))
def duplicate_columns(spark, sf_dir):
    return redundancy.duplicate_columns(view(spark, sf_dir, "contact_cards"), CARDS)


def _constant(c: str) -> str:
    t = f"NULLIF(CAST({c} AS VARCHAR), '')"
    return f"SELECT '{c}' AS \"column\", (SELECT COUNT(*) FROM contact_cards) AS n, (SELECT MAX(k) FROM (SELECT COUNT(*) AS k FROM contact_cards WHERE {t} IS NOT NULL GROUP BY {t})) AS top"


@register("constant_columns", ("contact_cards",), f"""
SELECT "column", CASE WHEN top IS NULL THEN 'empty' WHEN top = n THEN 'constant' ELSE 'nearly constant' END AS kind, ROUND(COALESCE(top / n, 0), 6) AS share
FROM ({q.union([_constant(c) for c in CARDS])}) WHERE top IS NULL OR top >= 0.95 * n""")
def constant_columns(spark, sf_dir):
    return redundancy.constant_columns(view(spark, sf_dir, "contact_cards"), CARDS).withColumn("share", F.round("share", 6))


SCORED = ["c_custkey", "segment", "balance", "balance_score", "balance_outlier"]


@register("outliers_zscore", ("dirty_customers",), """
WITH s AS (SELECT AVG(balance::DOUBLE) AS m, STDDEV_POP(balance::DOUBLE) AS d FROM dirty_customers)
SELECT c_custkey, segment, balance, ROUND((balance::DOUBLE - m) / d, 6) AS balance_score, ABS((balance::DOUBLE - m) / d) > 3 AS balance_outlier FROM dirty_customers, s""")
def outliers_zscore(spark, sf_dir):
    return st.z_scores(contacts(spark, sf_dir), ["balance"]).select(*SCORED).withColumn("balance_score", F.round("balance_score", 6))


@register("outliers_modified_z", ("dirty_customers",), f"""
WITH m AS (SELECT {q.at_index('balance', 'n // 2', 'dirty_customers')} AS med), d AS (SELECT ABS(balance::DOUBLE - med) AS apart FROM dirty_customers, m WHERE balance IS NOT NULL),
  s AS (SELECT med, {q.at_index('apart', 'n // 2', 'd')} AS mad FROM m)
SELECT c_custkey, segment, balance, ROUND(0.6745 * (balance::DOUBLE - med) / mad, 6) AS balance_score, ABS(0.6745 * (balance::DOUBLE - med) / mad) > 3.5 AS balance_outlier FROM dirty_customers, s""")
def outliers_modified_z(spark, sf_dir):
    return st.modified_z_scores(contacts(spark, sf_dir), ["balance"]).select(*SCORED).withColumn("balance_score", F.round("balance_score", 6))


JUDGED = CARDS[1:]
_QUALITY = f"""
WITH t AS ({_semantic_sql()}), n AS (SELECT COUNT(*) AS n FROM contact_cards),
  d AS (SELECT 'completeness' AS dimension, (SELECT SUM(filled) FROM t WHERE "column" <> 'order_no') AS good, (SELECT {len(JUDGED)} * n FROM n) AS "all"
    UNION ALL SELECT 'validity', SUM(matching), SUM(filled) FROM t WHERE "column" <> 'order_no' AND confidence IN ('high', 'medium')
    UNION ALL SELECT 'uniqueness', (SELECT COUNT(*) FROM (SELECT DISTINCT {', '.join(JUDGED)} FROM contact_cards)), n FROM n
    UNION ALL SELECT 'integrity', (SELECT COUNT(*) FROM contact_cards WHERE NOT COALESCE(status = 'F' AND order_no % 3 = 0, FALSE)), n FROM n),
  s AS (SELECT dimension, CAST(good AS BIGINT) AS good, CAST("all" AS BIGINT) AS "all", 100.0::DOUBLE * good / "all" AS score FROM d)
SELECT dimension, good, "all", ROUND(score, 6) AS score FROM s
UNION ALL SELECT 'overall', NULL, NULL, ROUND((SELECT SUM(score * CASE WHEN dimension = 'completeness' THEN 2 ELSE 1 END) / 5 FROM s), 6)"""


@register("quality_score", ("contact_cards",), _QUALITY)
def quality_score(spark, sf_dir):
    rules = {"closed early": F.expr("status = 'F' AND order_no % 3 = 0")}
    out = quality.quality_score(view(spark, sf_dir, "contact_cards"), JUDGED, rules=rules, weights={"completeness": 2.0})
    return out.withColumn("score", F.round("score", 6))
