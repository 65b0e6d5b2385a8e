"""Principal components, logistic fit and clusters of orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models
from ..session import kept
from .registry import register, view

SIZES = ["n_lines", "quantity", "price"]
K, SEED, ROUNDS = 3, 11, 6



def sizes(spark, sf_dir):
    """Models read their rows once a round or draw, so the lines are added up once and kept."""
    return kept(view(spark, sf_dir, "order_sizes"), "sizes")


_STANDARD = f"""m AS (SELECT {', '.join(f'AVG({c}) AS m_{c}, STDDEV_POP({c}) AS d_{c}' for c in SIZES)} FROM order_sizes),
  z AS (SELECT order_no, returned, {', '.join(f'({c} - m_{c}) / d_{c} AS z{i}' for i, c in enumerate(SIZES))} FROM order_sizes, m)"""

# Eigenvalues of a 3 x 3 correlation matrix by the cosine rule; an eigenvector is at right angles to two rows of the matrix less the value.
_PCA = f"""
WITH {_STANDARD},
  r AS (SELECT CORR(z0, z1) AS a, CORR(z0, z2) AS b, CORR(z1, z2) AS c FROM z),
  t AS (SELECT *, SQRT((a * a + b * b + c * c) / 3) AS p FROM r),
  e AS (SELECT a, b, c, k, 2 * p * COS(ACOS(a * b * c / (p * p * p)) / 3 + CASE WHEN k = 1 THEN 0 ELSE 4 * PI() / 3 END) AS l FROM t, (VALUES (1), (2)) AS ks(k)),
  v AS (SELECT k, l, a * c + b * l AS x, a * b + c * l AS y, l * l - a * a AS w FROM e),
  u AS (SELECT k, l, SIGN(CASE WHEN ABS(x) >= ABS(y) AND ABS(x) >= ABS(w) THEN x WHEN ABS(y) >= ABS(w) THEN y ELSE w END) / SQRT(x * x + y * y + w * w) AS f, x, y, w FROM v),
  l AS (SELECT k, 1 + l AS variance, f * x AS x, f * y AS y, f * w AS w FROM u)"""


@register("principal_components", ("order_sizes",), f"""{_PCA}
SELECT k AS component, ROUND(variance, 6) AS variance, ROUND(variance / 3, 6) AS share, ROUND(x, 6) AS n_lines, ROUND(y, 6) AS quantity, ROUND(w, 6) AS price FROM l""")
def principal_components(spark, sf_dir):
    rows = sizes(spark, sf_dir)
    out = models.principal_components(rows, SIZES, 2).table(rows).groupBy("component", "variance", "share").pivot("column", SIZES).agg(F.first("loading"))
    return out.select("component", *(F.round(c, 6).alias(c) for c in ["variance", "share", *SIZES]))


@register("principal_projection", ("order_sizes",), f"""{_PCA}
SELECT order_no, {', '.join(f"ROUND(z0 * l{i}.x + z1 * l{i}.y + z2 * l{i}.w, 5) AS pc{i}" for i in (1, 2))}
FROM z, (SELECT * FROM l WHERE k = 1) l1, (SELECT * FROM l WHERE k = 2) l2""")
def principal_projection(spark, sf_dir):
    rows = sizes(spark, sf_dir)
    return models.principal_components(rows, SIZES, 2).projected(rows).select("order_no", F.round("pc1", 5).alias("pc1"), F.round("pc2", 5).alias("pc2"))


def _newton(rounds: int) -> str:
    """A round per table: sums of gradient and curvature at the last point, and the step by Cramer's rule."""
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS i, 0.0::DOUBLE AS p, 0.0::DOUBLE AS q)"]
    for n in range(1, rounds + 1):
        steps.append(f"""s{n} AS (SELECT i, p, q, SUM(w) AS a, SUM(w * z0) AS b, SUM(w * z1) AS c, SUM(w * z0 * z0) AS d, SUM(w * z0 * z1) AS e, SUM(w * z1 * z1) AS f, SUM(g) AS u, SUM(g * z0) AS v, SUM(g * z1) AS x
    FROM (SELECT *, returned - h AS g, h * (1 - h) AS w FROM (SELECT *, 1 / (1 + EXP(-(i + p * z0 + q * z1))) AS h FROM z, b{n - 1})) GROUP BY i, p, q),
  t{n} AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s{n}),
  b{n} AS (SELECT i + (u * (d * f - e * e) - b * (v * f - e * x) + c * (v * e - d * x)) / det AS i, p + (a * (v * f - e * x) - u * (b * f - e * c) + c * (b * x - v * c)) / det AS p,
    q + (a * (d * x - v * e) - b * (b * x - v * c) + u * (b * e - d * c)) / det AS q FROM t{n})""")
    return ", ".join(steps)


_FIT = f"""
WITH {_STANDARD}, {_newton(8)},
  chances AS (SELECT returned AS y, 1 / (1 + EXP(-(i + p * z0 + q * z1))) AS h FROM z, b8)"""


@register("logistic_fit", ("order_sizes",), f"""{_FIT}
SELECT (SELECT COUNT(*) FROM z) AS n, ROUND(i - p * m_n_lines / d_n_lines - q * m_quantity / d_quantity, 5) AS intercept, ROUND(p / d_n_lines, 5) AS n_lines, ROUND(q / d_quantity, 5) AS quantity,
  (SELECT ROUND(AVG(-LN(CASE WHEN y = 1 THEN h ELSE 1 - h END)), 6) FROM chances) AS log_loss FROM b8, m""")
def logistic_fit(spark, sf_dir):
    fit = models.logistic_fit(sizes(spark, sf_dir), "returned", SIZES[:2])
    row = (fit.n, round(fit.intercept, 5), *(round(b, 5) for b in fit.coefficients), round(fit.log_loss, 6))
    return spark.createDataFrame([row], "n long, intercept double, n_lines double, quantity double, log_loss double")


# Rounded chances tie in the same rows on both sides.
@register("logistic_metrics", ("order_sizes",), f"""{_FIT},
  c AS (SELECT y, ROUND(h, 6) AS h FROM chances), k AS (SELECT y, h, rank() OVER (ORDER BY h) + (COUNT(*) OVER (PARTITION BY h) - 1) / 2.0 AS place FROM c),
  t AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE h >= 0.5 AND y = 1) AS tp, COUNT(*) FILTER (WHERE h >= 0.5 AND y = 0) AS fp, COUNT(*) FILTER (WHERE h < 0.5 AND y = 0) AS tn, COUNT(*) FILTER (WHERE h < 0.5 AND y = 1) AS fn,
    AVG(-LN(CASE WHEN y = 1 THEN h ELSE 1 - h END)) AS log_loss, SUM(CASE WHEN y = 1 THEN place::DOUBLE END) AS places FROM k)
SELECT n, tp, fp, tn, fn, ROUND((tp + tn) / n, 6) AS accuracy, ROUND(tp / (tp + fp), 6) AS precision, ROUND(tp / (tp + fn), 6) AS recall, ROUND(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  ROUND(log_loss, 6) AS log_loss, ROUND((places - (tp + fn) * (tp + fn + 1) / 2) / ((tp + fn) * (tn + fp)), 6) AS auc FROM t""")
def logistic_metrics(spark, sf_dir):
    rows = sizes(spark, sf_dir)
    fit = models.logistic_fit(rows, "returned", SIZES[:2])
    out = models.classification_metrics(rows.select("returned", F.round(fit.chance(rows), 6).alias("h")), "returned", "h")
    return out.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes))


def _apart(of: str) -> str:
    return " + ".join(f"(z.z{i} - {of}.z{i}) * (z.z{i} - {of}.z{i})" for i in range(len(SIZES)))


def _clusters_sql(k: int, seed: int, rounds: int) -> str:
    """Every draw and every round is a table; centers stand in a row each."""
    at = ", ".join(f"z{i}" for i in range(len(SIZES)))
    parts = [_STANDARD]
    for turn in range(k):
        near = f"(SELECT MIN({_apart('c')}) FROM ({' UNION ALL '.join(f'SELECT * FROM c{j}' for j in range(turn))}) c)" if turn else "1.0"
        u = f"(CAST('0x' || substr(md5('{seed}:{turn}:' || CAST(order_no AS VARCHAR)), 1, 12) AS BIGINT)::DOUBLE + 1) / 281474976710656.0"
        parts.append(f"n{turn} AS (SELECT {u} AS u, {near} AS near, {at} FROM z), c{turn} AS (SELECT {at} FROM n{turn} WHERE near > 0 ORDER BY -LN(u) / near LIMIT 1)")
    parts.append("k0 AS (" + " UNION ALL ".join(f"SELECT {i} AS cluster, {at} FROM c{i}" for i in range(k)) + ")")
    for n in range(rounds + 1):
        parts.append(f"a{n} AS (SELECT z.order_no, arg_min(c.cluster, {{'d': {_apart('c')}, 'c': c.cluster}}) AS cluster FROM z, k{n} c GROUP BY z.order_no)")
        if n < rounds:
            means = ", ".join(f"AVG(z.z{i}) AS z{i}" for i in range(len(SIZES)))
            parts.append(f"k{n + 1} AS (SELECT cluster, {means} FROM z JOIN a{n} USING (order_no) GROUP BY cluster)")
    return "WITH " + ", ".join(parts)


_CLUSTERS = _clusters_sql(K, SEED, ROUNDS)
_NORM = "z.z0 * z.z0 + z.z1 * z.z1 + z.z2 * z.z2"
_SILHOUETTES = f"""{_CLUSTERS},
  s AS (SELECT cluster, COUNT(*) AS n, SUM({_NORM}) AS q, SUM(z0) AS s0, SUM(z1) AS s1, SUM(z2) AS s2 FROM z JOIN a{ROUNDS} USING (order_no) GROUP BY cluster),
  far AS (SELECT z.order_no, a.cluster, s.cluster = a.cluster AS own, (n * ({_NORM}) - 2 * (z.z0 * s0 + z.z1 * s1 + z.z2 * s2) + q) / (n - CASE WHEN s.cluster = a.cluster THEN 1 ELSE 0 END) AS apart
    FROM z JOIN a{ROUNDS} a ON z.order_no = a.order_no, s),
  two AS (SELECT order_no, cluster, MAX(apart) FILTER (WHERE own) AS x, MIN(apart) FILTER (WHERE NOT own) AS y FROM far GROUP BY order_no, cluster),
  scored AS (SELECT order_no, cluster, (y - x) / GREATEST(x, y) AS silhouette FROM two)"""


def _clustered(spark, sf_dir):
    rows = sizes(spark, sf_dir)
    found = models.kmeans(rows, SIZES, K, ["order_no"], SEED, ROUNDS)
    return found, found.silhouettes(found.assigned(rows))


@register("kmeans_clusters", ("order_sizes",), f"{_SILHOUETTES} SELECT order_no, cluster, ROUND(silhouette, 5) AS silhouette FROM scored")
def kmeans_clusters(spark, sf_dir):
    return _clustered(spark, sf_dir)[1].select("order_no", "cluster", F.round("silhouette", 5).alias("silhouette"))


@register("kmeans_summary", ("order_sizes",), f"""{_SILHOUETTES}
SELECT cluster, COUNT(*) AS rows, ROUND(AVG(silhouette), 5) AS silhouette, {', '.join(f'ROUND(AVG({c}), 4) AS {c}' for c in SIZES)} FROM scored JOIN order_sizes USING (order_no) GROUP BY cluster""")
def kmeans_summary(spark, sf_dir):
    found, rows = _clustered(spark, sf_dir)
    return found.table(rows).select("cluster", "rows", F.round("silhouette", 5).alias("silhouette"), *(F.round(c, 4).alias(c) for c in SIZES))
