"""Correlation and regression from one moment matrix, and rank correlation.

The moment matrix of k measures (counts, sums, squares and products over the rows where both are filled) is 4 k * k numbers. Every
task adds up its rows' and hands on one list, so a table of any size costs one scan, and no pair a scan of its own. Values are taken
relative to the columns' means, found by an aggregate before, so large numbers that differ little keep their digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import numeric_of
from ..session import kept
from .ranges import bounds_of, range_index


@dataclass
class Moments:
    """Over the rows where columns i and j are filled: `n`, and of column i's distances from its `center` the sums, squares and products with j's."""

    columns: list[str]
    center: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        """Of the population; not a number where no row has both."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.products / self.n - self.sums * self.sums.T / self.n**2

    def correlation(self) -> np.ndarray:
        """Pearson's r of every pair; not a number where a column does not vary over the pair's rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = self.squares - self.sums**2 / self.n
            spread[spread <= 1e-12 * self.squares] = np.nan
            return self.covariance() * self.n / np.sqrt(spread * spread.T)


def _number(df: DataFrame, name: str) -> Column:
    value = numeric_of(df, name).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def moments(df: DataFrame, columns: list[str], complete: bool = False, center: list[float] | None = None) -> Moments:
    """The moment matrix of numbers (text is parsed; what is no finite number is missing); of rows with all of them if `complete`.

    Numbers near the means can be given as `center`; otherwise the means are found first.
    """
    numbers = df.select(*(_number(df, c).alias(f"x{i}") for i, c in enumerate(columns)))
    if complete:
        numbers = numbers.dropna()
    k = len(columns)
    means = numbers.agg(*(F.avg(f"x{i}") for i in range(k))).first() if center is None else center
    center = np.array([m or 0.0 for m in means])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((4, k, k))
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, k))
            filled = ~np.isnan(rows)
            apart, filled = np.where(filled, rows - center, 0.0), filled.astype(np.float64)
            out += filled.T @ filled, apart.T @ filled, (apart * apart).T @ filled, apart.T @ apart
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, out.size], pa.int32()), pa.array(out.ravel()))], ["parts"])

    added = numbers.mapInArrow(add_up, "parts array<double>").select(F.posexplode("parts").alias("at", "part")).groupBy("at").agg(F.sum("part").alias("part"))
    found = np.zeros(4 * k * k)
    for row in added.collect():  # 4 k * k numbers
        found[row["at"]] = row.part
    return Moments(list(columns), center, *found.reshape(4, k, k))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(first, second, n, r) of every pair of columns, each with itself too: pairwise complete. r is null where a column does not vary."""
    found = moments(df, columns)
    r = found.correlation()
    rows = [(a, b, int(found.n[i, j]), None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "first string, second string, n long, r double")


def mid_ranks(df: DataFrame, columns: list[str], parts: int | None = None) -> list[DataFrame]:
    """For every column of numbers (value, rank): the middle of the places that equal values share, from 1.

    Distinct values are counted (once: the counts are kept), dealt out by ranges and counted up within each; a range starts after all earlier ones. No
    window spans the table, and what the driver sees is one number per column and range.
    """
    bounds = bounds_of(df, [F.col(c) for c in columns], parts)
    counted = []
    for c, b in zip(columns, bounds, strict=True):
        counts = df.select(F.col(c).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
        counted.append(kept(counts.withColumn("range", range_index(F.col("value"), b)), "counts"))
    sums = [c.groupBy("range").agg(F.sum("n").alias("n")).select(F.lit(i).alias("i"), "range", "n") for i, c in enumerate(counted)]
    sizes = {(r.i, r.range): r.n for r in reduce(DataFrame.unionByName, sums).collect()}
    out = []
    for i, (counts, b) in enumerate(zip(counted, bounds, strict=True)):
        before = np.concatenate(([0], np.cumsum([sizes.get((i, j), 0) for j in range(len(b))])))
        start = F.element_at(F.array(*(F.lit(int(x)) for x in before)).cast("array<bigint>"), F.col("range") + 1)
        upto = F.sum("n").over(Window.partitionBy("range").orderBy("value"))
        out.append(counts.select("value", (start + upto - (F.col("n") - 1) / 2).alias("rank")))
    return out


def spearman(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """(first, second, n, r) of every pair of columns over the rows where all of them are numbers. r is null where a column does not vary."""
    names = [f"x{i}" for i in range(len(columns))]
    ranked = df.select(*(_number(df, c).alias(x) for c, x in zip(columns, names, strict=True))).dropna()
    for x, ranks in zip(names, mid_ranks(ranked, names, parts), strict=True):
        ranked = ranked.join(ranks.select(F.col("value").alias(x), F.col("rank").alias(f"r{x}")), x)
    middle = [(df.select(*(_number(df, c) for c in columns)).dropna().count() + 1) / 2] * len(names)
    found = moments(ranked, [f"r{x}" for x in names], complete=True, center=middle)
    r = found.correlation()
    rows = [(a, b, int(found.n[i, j]), None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "first string, second string, n long, r double")


@dataclass
class LinearFit:
    """`target` as intercept + coefficients * features, by least squares over complete rows."""

    features: list[str]
    coefficients: list[float]
    intercept: float
    n: int
    r_squared: float | None
    rmse: float | None

    def predicted(self, df: DataFrame) -> Column:
        return sum((F.lit(b) * _number(df, f) for f, b in zip(self.features, self.coefficients, strict=True)), F.lit(self.intercept))


def linear_fit(df: DataFrame, target: str, features: list[str]) -> LinearFit:
    """Normal equations from the moment matrix: one scan after the means, whatever the number of rows. Of features that say the same,
    the solution of least length is taken."""
    found = moments(df, [*features, target], complete=True)
    n = int(found.n[0, 0])
    if n == 0:
        return LinearFit(features, [float("nan")] * len(features), float("nan"), 0, None, None)
    cov, means = found.covariance(), found.center + found.sums[:, 0] / n
    b = np.linalg.lstsq(cov[:-1, :-1], cov[:-1, -1], rcond=1e-12)[0]
    left = max(float(cov[-1, -1] - b @ cov[:-1, -1]), 0.0)
    share = 1 - left / float(cov[-1, -1]) if cov[-1, -1] > 0 else None
    return LinearFit(features, [float(x) for x in b], float(means[-1] - b @ means[:-1]), n, share, left**0.5)
