"""Components, logistic fit and clusters against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.operators import models


def points(n=300):
    rng = np.random.default_rng(3)
    middles = np.array([[0.0, 0.0, 5.0], [8.0, 1.0, 5.0], [1.0, 9.0, 5.0]])
    return [(i, *(float(x) for x in middles[i % 3] + rng.normal(size=3) * [1, 1, 0])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_components_are_eigenvectors_and_project_rows(spark):
    rows = [(i, a, b + a / 2, c) for i, a, b, c in points()]
    df = frame(spark, [*rows, (900, None, 1.0, 2.0), (901, float("nan"), 1.0, 2.0)])
    x = np.array([r[1:3] for r in rows])
    for standardize in (True, False):
        fit = models.principal_components(df, ["a", "b"], standardize=standardize)
        assert fit.n == 300 and fit.shares.sum() == pytest.approx(1)
        z = (x - x.mean(axis=0)) / (x.std(axis=0) if standardize else 1)
        got = fit.projected(df, "p").orderBy("id").select("p1", "p2").collect()
        p = np.array([tuple(r) for r in got[:300]])
        assert p.var(axis=0) == pytest.approx(fit.variances) and np.corrcoef(p.T)[0, 1] == pytest.approx(0, abs=1e-9)
        assert p == pytest.approx(z @ fit.loadings.T) and [tuple(r) for r in got[300:]] == [(None, None)] * 2
        assert all(row[np.argmax(np.abs(row))] > 0 for row in fit.loadings)
    flat = models.principal_components(df, ["a", "c"])  # c does not vary
    assert flat.variances == pytest.approx([1, 0]) and flat.loadings[0] == pytest.approx([1, 0])
    assert models.principal_components(df.limit(0), ["a", "b"], 1).table(df).count() == 2


def plain_logistic(x, y, ridge=0.0):
    x = np.column_stack((np.ones(len(x)), x))
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        penalty = np.array([0] + [ridge] * (x.shape[1] - 1))
        beta -= np.linalg.solve((x.T * (p * (1 - p))) @ x / len(x) + np.diag(penalty), x.T @ (p - y) / len(x) + penalty * beta)
    return beta


def test_logistic_fit_and_its_figures(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2)) * [1, 100] + [3, 1e6]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 3 + (x[:, 1] - 1e6) / 50)))).astype(int)
    rows = [(float(a), str(b), int(t)) for (a, b), t in zip(x, y, strict=True)] + [(None, "1", 1), (1.0, "text", 0), (1.0, "2", 7), (1.0, "2", None)]
    df = spark.createDataFrame(rows, "a double, b string, y int").repartition(5)
    fit = models.logistic_fit(df, "y", ["a", "b"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    beta = plain_logistic(z, y)
    assert fit.n == 400 and fit.converged and np.array(fit.coefficients) * x.std(axis=0) == pytest.approx(beta[1:], rel=1e-7)
    p = 1 / (1 + np.exp(-(beta[0] + z @ beta[1:])))
    assert fit.log_loss == pytest.approx(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))
    scored = df.withColumn("p", fit.chance(df))
    got = models.classification_metrics(scored, "y", "p").first()
    tp, fp, fn = sum((p >= 0.5) & (y == 1)), sum((p >= 0.5) & (y == 0)), sum((p < 0.5) & (y == 1))
    wins = [1.0 if a > b else 0.5 if a == b else 0.0 for a in p[y == 1] for b in p[y == 0]]
    assert (got.n, got.tp, got.fp, got.fn) == (400, tp, fp, fn) and got.auc == pytest.approx(np.mean(wins))
    assert got.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn)) and got.log_loss == pytest.approx(fit.log_loss)
    tied = models.classification_metrics(scored.withColumn("p", F.round("p", 1)), "y", "p").first()
    p = np.array([round(v, 1) for v in p])
    assert tied.auc == pytest.approx(np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in p[y == 1] for b in p[y == 0]]), abs=2e-3)


def test_logistic_fit_without_a_finite_answer(spark):
    df = spark.createDataFrame([(float(i), int(i >= 10), 1) for i in range(20)], "x double, y int, one int")
    assert not models.logistic_fit(df, "y", ["x"], rounds=8).converged
    ridged = models.logistic_fit(df, "y", ["x"], ridge=0.01)
    x = (np.arange(20) - 9.5) / np.arange(20).std()
    assert ridged.converged and ridged.coefficients[0] * np.arange(20).std() == pytest.approx(plain_logistic(x[:, None], np.arange(20) >= 10, 0.01)[1], rel=1e-6)
    assert not models.logistic_fit(df, "one", ["x"]).converged and models.logistic_fit(df.limit(0), "y", ["x"]).n == 0
    alone = models.classification_metrics(df.withColumn("p", F.lit(0.9)), "one", "p").first()
    assert alone.auc is None and alone.recall == 1 and models.classification_metrics(df.limit(0), "y", "x").first().accuracy is None


def test_clusters_are_found_whatever_the_partitions(spark):
    rows = points()
    df = frame(spark, [*rows, (900, None, 1.0, 5.0)])
    found = models.kmeans(df, ["a", "b", "c"], 3, ["id"], seed=1)
    out = found.silhouettes(found.assigned(df)).orderBy("id").collect()
    assert found.settled and out[300].cluster is None and out[300].silhouette is None
    names = [r.cluster for r in out[:300]]
    assert sorted(set(names)) == [0, 1, 2] and all(names[i] == names[i % 3] for i in range(300))
    again = models.kmeans(df.repartition(7), ["a", "b", "c"], 3, ["id"], seed=1)
    assert again.centers == pytest.approx(found.centers)
    x = np.array([r[1:] for r in rows])
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1)
    for i in range(0, 300, 29):
        apart = ((z - z[i]) ** 2).sum(axis=1)
        means = [apart[np.array(names) == k].sum() / (sum(n == k for n in names) - (k == names[i])) for k in range(3)]
        other = min(m for k, m in enumerate(means) if k != names[i])
        assert out[i].silhouette == pytest.approx((other - means[names[i]]) / max(other, means[names[i]]))
    table = found.table(found.silhouettes(found.assigned(df))).collect()
    assert sum(r.rows for r in table) == 300 and all(r.silhouette > 0.7 for r in table)


def test_clusters_of_few_or_equal_rows(spark):
    same = frame(spark, [(i, 1.0, 2.0, 3.0) for i in range(9)] + [(9, 4.0, 2.0, 3.0)])
    found = models.kmeans(same, ["a", "b"], 5, ["id"])
    assert len(found.centers) == 2
    out = found.silhouettes(found.assigned(same)).orderBy("id").collect()
    assert len({r.cluster for r in out[:9]}) == 1 and out[9].cluster != out[0].cluster
    assert out[9].silhouette == 0 and out[0].silhouette == pytest.approx(1)
    one = models.kmeans(same, ["a"], 1, ["id"])
    assert {r.silhouette for r in one.silhouettes(one.assigned(same)).collect()} == {0.0}
    none = models.kmeans(same.limit(0), ["a"], 3, ["id"])
    assert none.silhouettes(none.assigned(same)).where("cluster IS NOT NULL").count() == 0


def test_draws_follow_squared_distances(spark):
    """The race's least key falls on a row with a chance in proportion to its weight."""
    df = spark.range(3000).select("id", models.race_key([F.col("id")], 4, 1).alias("u"))
    u = [r.u for r in df.collect()]
    assert 0 < min(u) and max(u) <= 1 and np.mean(u) == pytest.approx(0.5, abs=0.03)
    wins = sum(-math.log(u[2 * i]) / 3 < -math.log(u[2 * i + 1]) for i in range(1500))
    assert wins / 1500 == pytest.approx(0.75, abs=0.04)
