"""Principal components, logistic fit and clusters, each from grouped sums over the rows.

Nothing but sums leaves a task: k * k moments for components, a gradient and a curvature matrix for a round of the logistic fit, a
count and a sum of coordinates per cluster for a round of clustering. The driver holds what is fitted, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from .moments import Moments, _number, mid_ranks, moments

_SHARP = 1e-10


def _complete(df: DataFrame, columns: list[str]) -> Column:
    complete = F.lit(True)
    for c in columns:
        complete = complete & _number(df, c).isNotNull()
    return complete


def _scaled(found: Moments) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and spreads of complete rows. A column that does not vary has the spread 1, so it becomes 0 everywhere."""
    n = int(found.n[0, 0])
    if n == 0:
        return 0, found.center, np.ones(len(found.columns))
    variance = np.diag(found.covariance()).copy()
    variance[variance <= 1e-12 * np.maximum(np.diag(found.squares) / n, 1e-300)] = 1.0
    return n, found.center + found.sums[:, 0] / n, np.sqrt(variance)


@dataclass
class Components:
    """Directions of largest variance: `loadings` has one row per component, over columns taken as (value - mean) / scale."""

    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    loadings: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    n: int

    def projected(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """`df` with one column per component; null where a column is no number."""
        parts = [(_number(df, c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.means, self.scales, strict=True)]
        sums = [sum((F.lit(float(w)) * p for w, p in zip(row, parts, strict=True)), F.lit(0.0)) for row in self.loadings]
        return df.withColumns({f"{prefix}{i + 1}": s for i, s in enumerate(sums)})

    def table(self, df: DataFrame) -> DataFrame:
        """(component, variance, share, column, loading) of every component and column."""
        rows = [(i + 1, float(self.variances[i]), float(self.shares[i]), c, float(self.loadings[i, j])) for i in range(len(self.loadings)) for j, c in enumerate(self.columns)]
        return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, column string, loading double")


def principal_components(df: DataFrame, columns: list[str], count: int | None = None, standardize: bool = True) -> Components:
    """Eigenvectors of the correlation matrix (of the covariance matrix unless `standardize`) of complete rows, largest variance first.

    One scan after the means. The largest loading of a component is positive (of equal ones, the first). Without complete rows all
    loadings are 0.
    """
    found = moments(df, columns, complete=True)
    n, means, scales = _scaled(found)
    k = len(columns)
    if n == 0:
        return Components(columns, means, scales, np.zeros((count or k, k)), np.zeros(count or k), np.zeros(count or k), 0)
    if not standardize:
        scales = np.ones(k)
    values, vectors = np.linalg.eigh(found.covariance() / np.outer(scales, scales))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1].T
    for v in vectors:
        largest = int(np.flatnonzero(np.abs(v) >= np.abs(v).max() * (1 - 1e-9))[0])
        v *= 1 if v[largest] >= 0 else -1
    shares = values / values.sum() if values.sum() > 0 else np.zeros(k)
    return Components(columns, means, scales, vectors[:count], values[:count], shares[:count], n)


@dataclass
class LogisticFit:
    """The chance that a label is 1: 1 / (1 + exp(-(intercept + coefficients * features)))."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    n: int
    rounds: int
    converged: bool
    log_loss: float | None

    def chance(self, df: DataFrame) -> Column:
        score = sum((F.lit(b) * _number(df, f) for f, b in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))
        return 1 / (1 + F.exp(-score))


def logistic_fit(df: DataFrame, target: str, features: list[str], ridge: float = 0.0, rounds: int = 30) -> LogisticFit:
    """Newton rounds over the rows with all features and a label that is 0 or 1; each is one scan that adds up gradient and curvature.

    Features are standardized for the fit only. A step that makes the mean loss larger is halved. `ridge` is a penalty on the standardized
    coefficients, of the mean loss; without it, labels that a feature tells apart exactly have no finite fit, and `converged` is false
    after the last round. Labels of one kind only and empty tables give coefficients of 0 and not a number.
    """
    label = _number(df, target)
    rows = df.where(_complete(df, [target, *features]) & label.isin(0.0, 1.0)).select(*(_number(df, c).alias(f"x{i}") for i, c in enumerate(features)), label.alias("y"))
    names = [f"x{i}" for i in range(len(features))]
    found = moments(rows, [*names, "y"], complete=True)
    n, means, scales = _scaled(found)
    if n == 0 or not 0 < means[-1] < 1:
        return LogisticFit(features, [0.0] * len(features), float("nan"), n, 0, False, None)
    means, scales, width = means[:-1], scales[:-1], len(features) + 1

    def summed(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(width * width + width + 1)
            for batch in batches:
                table = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
                x, y = np.column_stack((np.ones(len(table)), (table[:, :-1] - means) / scales)), table[:, -1]
                score = x @ beta
                chance = np.exp(-np.logaddexp(0.0, -score))
                curvature = (x * (chance * (1 - chance))[:, None]).T @ x
                loss = np.logaddexp(0.0, score) - y * score
                out += np.concatenate((curvature.ravel(), x.T @ (chance - y), [loss.sum()]))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out))], ["parts"])

        added = rows.mapInArrow(add_up, "parts array<double>").select(F.posexplode("parts").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("part"))
        out = np.zeros(width * width + width + 1)
        for row in added.collect():  # width * width + width + 1 numbers
            out[row["at"]] = row.part
        penalty = np.array([0.0] + [ridge] * len(features))
        curvature = out[: width * width].reshape(width, width) / n + np.diag(penalty)
        return curvature, out[width * width : -1] / n + penalty * beta, float(out[-1] / n + penalty @ (beta * beta) / 2)

    beta = np.zeros(width)
    curvature, gradient, loss = summed(beta)
    step, done, passed = np.linalg.lstsq(curvature, -gradient, rcond=1e-12)[0], 0, False
    while done < rounds and not passed:
        done += 1
        tried = beta + step
        curvature, gradient, now = summed(tried)
        if now > loss + 1e-13:
            step = step / 2
            continue
        passed = bool(np.abs(step).max() < _SHARP or np.abs(gradient).max() < 1e-13)
        beta, loss = tried, now
        step = np.linalg.lstsq(curvature, -gradient, rcond=1e-12)[0]
    b = beta[1:] / scales
    return LogisticFit(features, [float(x) for x in b], float(beta[0] - b @ means), n, done, passed, loss)


def classification_metrics(df: DataFrame, target: str, chance: str, threshold: float = 0.5) -> DataFrame:
    """One row: n, true and false positives and negatives, accuracy, precision, recall, f1, log_loss and the area under the curve.

    Rows without a label of 0 or 1 or without a chance do not count. The area comes from mid-ranks of the chances, ties shared; a figure
    whose divisor is 0 is null.
    """
    y, p = _number(df, target), _number(df, chance)
    rows = df.select(y.alias("y"), p.alias("p")).where(F.col("y").isin(0.0, 1.0) & F.col("p").isNotNull())
    said, one = F.col("p") >= F.lit(threshold), F.col("y") == 1
    apart = lambda c: F.greatest(F.lit(1e-15), c)
    counts = rows.agg(
        F.count("*").alias("n"), F.count_if(said & one).alias("tp"), F.count_if(said & ~one).alias("fp"), F.count_if(~said & ~one).alias("tn"), F.count_if(~said & one).alias("fn"),
        F.avg(-F.log(apart(F.when(one, F.col("p")).otherwise(1 - F.col("p"))))).alias("log_loss"),
    )
    ranks = mid_ranks(rows, ["p"])[0].withColumnRenamed("value", "p")
    places = rows.where(one).groupBy("p").agg(F.count("*").alias("k")).join(ranks, "p").agg(F.sum(F.col("k") * F.col("rank")).alias("places")).first().places
    found, all_one = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    none = F.col("n") - found
    precision, recall = F.try_divide(F.col("tp"), all_one), F.try_divide(F.col("tp"), found)
    area = F.try_divide(F.lit(places).cast("double") - found * (found + 1) / 2, found.cast("double") * none)
    return counts.select(
        "n", "tp", "fp", "tn", "fn", F.try_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"), "log_loss", area.alias("auc"),
    )


@dataclass
class Clusters:
    """Centers over columns taken as (value - mean) / scale; `settled` if the last round moved none of them."""

    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    centers: np.ndarray
    rounds: int
    settled: bool

    def _apart(self, df: DataFrame) -> list[Column]:
        z = _standard(df, self.columns, self.means, self.scales)
        return [_square(z, c) for c in self.centers]

    def assigned(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        """`df` with the number of each row's nearest center (of equally near ones, the first); null where a column is no number."""
        if not len(self.centers):
            return df.withColumn(name, F.lit(None).cast("int"))
        return df.withColumn(name, _nearest(self._apart(df)))

    def silhouettes(self, df: DataFrame, cluster: str = "cluster", name: str = "silhouette") -> DataFrame:
        """`df`, as `assigned` gave it, with each row's silhouette by squared distances, from -1 to 1.

        The mean squared distance from x to a cluster's members is |x|^2 - 2 x * (their mean) + (the mean of their |y|^2), so grouped sums
        say all about the others, and no pair of rows meets. A row's own cluster counts without the row. A cluster of one, and
        a table with one cluster, have 0; rows without a cluster null.
        """
        z = _standard(df, self.columns, self.means, self.scales)
        k, d = len(self.centers), len(self.columns)
        norm = sum((x * x for x in z), F.lit(0.0))
        sums = df.where(col_of(cluster).isNotNull()).groupBy(col_of(cluster).alias("c")).agg(F.count("*").alias("n"), F.sum(norm).alias("q"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(z)))
        of = {r.c: r for r in sums.collect()}  # one row per cluster
        row = lambda r: F.struct(F.lit(float(r.n)).alias("n"), F.lit(float(r.q)).alias("q"), F.array(*(F.lit(float(r[f"s{j}"])) for j in range(d))).alias("s"))
        none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("q"), F.array(*(F.lit(0.0) for _ in range(d))).alias("s"))
        known = F.array(*(row(of[i]) if i in of else none for i in range(k))) if k else F.array()
        add = lambda total, x: total + x
        at, own_at = F.col("__at"), col_of(cluster)

        # Arrays keep the plan's size apart from the number of clusters and columns.
        def apart(c: Column, i: Column) -> Column:
            far = c["n"] * F.aggregate(at, F.lit(0.0), lambda total, x: total + x * x) - 2 * F.aggregate(F.zip_with(at, c["s"], lambda x, y: x * y), F.lit(0.0), add) + c["q"]
            return F.greatest(F.try_divide(far, c["n"] - F.when(i == own_at, 1.0).otherwise(0.0)), F.when(c["n"] > F.when(i == own_at, 1.0).otherwise(0.0), 0.0))

        if not k:
            return df.withColumn(name, F.lit(None).cast("double"))
        out = df.withColumn("__at", F.array(*z)).withColumn("__apart", F.when(own_at.isNotNull(), F.transform(known, apart)))
        out = out.withColumn("__own", F.get("__apart", own_at)).withColumn("__other", F.array_min(F.filter("__apart", lambda x, i: i != own_at)))
        value = F.coalesce(F.try_divide(F.col("__other") - F.col("__own"), F.greatest("__own", "__other")), F.lit(0.0))
        lone = F.col("__own").isNull() | F.col("__other").isNull()
        return out.withColumn(name, F.when(own_at.isNotNull(), F.when(lone, 0.0).otherwise(value))).drop("__at", "__apart", "__own", "__other")

    def table(self, df: DataFrame, cluster: str = "cluster", silhouette: str = "silhouette") -> DataFrame:
        """(cluster, rows, silhouette, column means) of a table that `assigned` and `silhouettes` have gone over."""
        means = [F.avg(_number(df, c)).alias(c) for c in self.columns]
        return df.where(col_of(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("rows"), F.avg(col_of(silhouette)).alias("silhouette"), *means)


def _standard(df: DataFrame, columns: list[str], means: np.ndarray, scales: np.ndarray) -> list[Column]:
    return [(_number(df, c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(columns, means, scales, strict=True)]


def _square(z: list[Column], center: np.ndarray) -> Column:
    return sum(((x - F.lit(float(m))) * (x - F.lit(float(m))) for x, m in zip(z, center, strict=True)), F.lit(0.0))


def _nearest(apart: list[Column]) -> Column:
    all_of = F.array(*apart)
    return F.when(apart[0].isNotNull(), F.array_position(all_of, F.array_min(all_of)).cast("int") - 1)


def race_key(ids: list[Column], seed: int, turn: int) -> Column:
    """A number above 0 and at most 1 from a digest of the row's ids, another one in every turn."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), *(F.coalesce(i.cast("string"), F.lit("")) for i in ids)))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1) / F.lit(float(1 << 48))


def kmeans(df: DataFrame, columns: list[str], k: int, ids: list[str], seed: int = 0, rounds: int = 50, standardize: bool = True) -> Clusters:
    """At most `k` clusters of the complete rows, by rounds of assignment and means.

    First centers are drawn with a chance in proportion to the squared distance from those there (the first one evenly): among keys u
    made of the row's ids, -ln(u) / distance is least for a row with just that chance, so a draw is one aggregate, and every run
    and every redone task draws the same. Fewer different rows than `k` give fewer clusters. A cluster that loses all rows keeps its
    center. Rounds end when no center moves. Each round is one scan with one row per task and cluster shuffled.
    """
    found = moments(df, columns, complete=True)
    n, means, scales = _scaled(found)
    if n == 0:
        return Clusters(columns, means, scales, np.zeros((0, len(columns))), 0, True)
    if not standardize:
        scales = np.ones(len(columns))
    z = [f"z{i}" for i in range(len(columns))]
    points = df.where(_complete(df, columns)).select(*(x.alias(name) for x, name in zip(_standard(df, columns, means, scales), z, strict=True)), *(col_of(i).alias(f"id{j}") for j, i in enumerate(ids)))
    at, keys = [F.col(c) for c in z], [F.col(f"id{j}") for j in range(len(ids))]
    centers: list[np.ndarray] = []
    for turn in range(k):
        apart = [_square(at, c) for c in centers]
        near = F.least(*apart) if len(apart) > 1 else apart[0] if apart else F.lit(1.0)
        race = F.when(near > 0, -F.log(race_key(keys, seed, turn)) / near)
        drawn = points.agg(F.min(F.when(race.isNotNull(), F.struct(race.alias("race"), *at))).alias("least")).first().least
        if drawn is None:
            break
        centers.append(np.array([drawn[c] for c in z], dtype=float))
    fitted, done, settled = Clusters(z, np.zeros(len(z)), np.ones(len(z)), np.array(centers), 0, False), 0, False
    while done < rounds and not settled:
        done += 1
        sums = fitted.assigned(points).groupBy("cluster").agg(*(F.avg(c).alias(c) for c in z)).collect()  # one row per cluster
        moved = fitted.centers.copy()
        for row in sums:
            moved[row.cluster] = [row[c] for c in z]
        settled = bool(np.abs(moved - fitted.centers).max() < _SHARP)
        fitted.centers = moved
    return Clusters(columns, means, scales, fitted.centers, done, settled)
