"""Further statistics: moments and spread of numbers, histograms, association of categories, integrity, time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col_of, group_key, numeric_of
from .order_statistics import lower_quartile, order_statistics, upper_median, upper_quartile
from .profile import frequency_table


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: n, mean, variance, stddev, range, quartiles, mad, skewness, kurtosis, variation, mode and entropy.

    Moments are those of the population, kurtosis is in excess of the normal's, entropy is in nats, `mad` is the upper
    median of distances to the upper median, and of equally frequent values the least is the mode. Moments come from
    one aggregate, mode and entropy from the frequency table, order statistics from `order_statistics`.
    """
    positions = {"q1": lower_quartile, "median": upper_median, "q3": upper_quartile}
    found = order_statistics(df, {c: numeric_of(df, c) for c in columns}, positions)
    filled = [c for c in columns if found[c]["n"]]
    apart = {c: F.abs(numeric_of(df, c) - F.lit(found[c]["median"])) for c in filled}
    mad = order_statistics(df, apart, {"mad": upper_median}, counts={c: found[c]["n"] for c in filled})
    parts = []
    for i, c in enumerate(columns):
        v = numeric_of(df, c).cast("double")
        v = F.when(~F.isnan(v), v)
        parts += [f(v).alias(f"{k}{i}") for k, f in (("m", F.avg), ("v", F.var_pop), ("lo", F.min), ("hi", F.max), ("s", F.skewness), ("k", F.kurtosis))]

    def row(i: int, c: str) -> Column:
        order = {**found[c], **mad.get(c, {"mad": None})}
        spread = F.sqrt(F.col(f"v{i}"))
        return F.struct(
            F.lit(c).alias("column"), F.lit(found[c]["n"]).cast("bigint").alias("n"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance"), spread.alias("stddev"),
            (F.col(f"hi{i}") - F.col(f"lo{i}")).alias("range"), *(F.lit(order[k]).cast("double").alias(k) for k in ("q1", "median", "q3", "mad")),
            F.col(f"s{i}").alias("skewness"), F.col(f"k{i}").alias("kurtosis"), F.try_divide(spread, F.col(f"m{i}")).alias("variation"),
        )

    measured = df.agg(*parts).select(F.inline(F.array(*(row(i, c) for i, c in enumerate(columns)))))
    number, count = F.col("value").try_cast("double"), F.col("count")
    frequent = frequency_table(df, columns).groupBy("column").agg(
        F.max_by(number, F.struct(count, -number)).alias("mode"), (F.log(F.sum(count)) - F.sum(count * F.log(count)) / F.sum(count)).alias("entropy")
    )
    return measured.join(frequent, "column", "left")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count): bin 0 is below `low`, bins + 1 from `high` on; the others are equally wide. Empty bins have no row."""
    binned = F.width_bucket(numeric_of(df, column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.select(binned.alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("count"))


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, count) over the rows where both cells form a group."""
    keys = df.select(group_key(col_of(first)).alias("first"), group_key(col_of(second)).alias("second")).dropna()
    return keys.groupBy("first", "second").agg(F.count("*").alias("count"))


def association(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, chi_square, freedom and Cramér's v of two categories, from their contingency table."""
    table = contingency(df, first, second)
    rows = table.groupBy("first").agg(F.sum("count").alias("row"))
    columns = table.groupBy("second").agg(F.sum("count").alias("column"))
    shape = rows.agg(F.count("*").alias("r"), F.sum("row").alias("n")).first()
    width = columns.count()
    terms = table.join(rows, "first").join(columns, "second").agg(F.sum(F.col("count") * F.col("count") / (F.col("row") * F.col("column"))).alias("t"))
    chi = F.lit(shape.n) * (F.col("t") - 1)
    freedom, least = (shape.r - 1) * (width - 1), min(shape.r, width) - 1
    return terms.select(
        F.lit(shape.n).cast("bigint").alias("n"), chi.alias("chi_square"), F.lit(freedom).cast("bigint").alias("freedom"), F.sqrt(F.try_divide(chi, F.lit(shape.n or 0) * least)).alias("v")
    )


# --- integrity ----------------------------------------------------------------

def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, count) of keys that more than one row has."""
    return df.groupBy(*[col_of(k) for k in keys]).agg(F.count("*").alias("count")).where("count > 1")


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows with a key that `parent` lacks. A null key refers to nothing and is no orphan."""
    known = parent.select(col_of(parent_key).alias("_known"))
    return df.where(col_of(key).isNotNull()).join(known, col_of(key) == F.col("_known"), "left_anti")


def impossible_values(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows of which a rule's condition does not hold, from one scan. A null verdict is no violation."""
    counted = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([], [col_of(name) for name in rules], "rule", "violations")


# --- time series --------------------------------------------------------------

def rolling_average(series: DataFrame, time: str, value: str, width: int, by: str) -> DataFrame:
    """`series` (one row per group and period) with the average of the last `width` periods of the group."""
    frame = Window.partitionBy(col_of(by)).orderBy(col_of(time)).rowsBetween(1 - width, 0)
    return series.withColumn("rolling", F.avg(col_of(value)).over(frame))


def autocorrelation(series: DataFrame, day: str, value: str, lags: list[int]) -> DataFrame:
    """(lag, pairs, r): Pearson's r of a daily series with itself some days before. Days are joined, so nothing is sorted in one task."""
    own = series.select(col_of(day).alias("day"), col_of(value).cast("double").alias("x"))
    earlier = own.select(F.explode(F.array(*(F.lit(lag) for lag in lags))).alias("lag"), "day", F.col("x").alias("y"))
    earlier = earlier.select("lag", F.date_add("day", F.col("lag")).alias("day"), "y")
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    return own.join(earlier, "day").groupBy("lag").agg(F.count("*").alias("pairs"), r.alias("r"))


def seasonality(df: DataFrame, season: Column, value: str) -> DataFrame:
    """(season, index): the average of each season as a multiple of the average of all rows."""
    seasons = df.groupBy(season.alias("season")).agg(F.sum(numeric_of(df, value)).cast("double").alias("sum"), F.count(numeric_of(df, value)).alias("n"))
    whole = seasons.agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("mean"))
    return seasons.select("season", F.try_divide(F.try_divide("sum", "n"), whole.select("mean").scalar()).alias("index"))


# --- outliers -----------------------------------------------------------------

def _scored(df: DataFrame, scores: dict[str, Column], threshold: float) -> DataFrame:
    for c, score in scores.items():
        df = df.withColumns({f"{c}_score": score, f"{c}_outlier": F.coalesce(F.abs(score) > threshold, F.lit(False))})
    return df


def z_scores(df: DataFrame, columns: list[str], threshold: float = 3.0) -> DataFrame:
    """`df` with `<column>_score`, distances from the mean in standard deviations (of the population), and `<column>_outlier`.

    Means and deviations of all columns come from one aggregate. Null where a cell is no number or the column does not vary.
    """
    numbers = {c: numeric_of(df, c).cast("double") for c in columns}
    parts = [f(F.when(~F.isnan(v), v)) for v in numbers.values() for f in (F.avg, F.stddev_pop)]
    row = df.agg(*parts).first()
    scores = {c: F.try_divide(v - F.lit(row[2 * i]), F.lit(row[2 * i + 1])).cast("double") for i, (c, v) in enumerate(numbers.items())}
    return _scored(df, scores, threshold)


def modified_z_scores(df: DataFrame, columns: list[str], threshold: float = 3.5) -> DataFrame:
    """The same by medians: 0.6745 times the distance from the upper median, in upper medians of those distances.

    Two levels of order statistics, each for all columns at once; null where more than half the cells are equal.
    """
    numbers = {c: numeric_of(df, c) for c in columns}
    found = order_statistics(df, numbers, {"median": upper_median})
    filled = [c for c in columns if found[c]["n"]]
    apart = {c: numbers[c] - F.lit(found[c]["median"]) for c in filled}
    mad = order_statistics(df, {c: F.abs(d) for c, d in apart.items()}, {"mad": upper_median}, counts={c: found[c]["n"] for c in filled})
    scores = {c: F.try_divide(0.6745 * apart[c].cast("double"), F.lit(mad[c]["mad"]).cast("double")) if c in mad else F.lit(None).cast("double") for c in columns}
    return _scored(df, scores, threshold)
