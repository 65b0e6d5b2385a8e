"""Column profiles: counts, logical types, numeric statistics, top values, samples.

Two passes over the data serve any number of columns. One global aggregate
gives the facts that need no grouping; one long-form frequency table, grouped
by (column, value) with map-side combining, gives distinct counts and top
values. Results have one row per column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coerce import col_of, js_number, missing_of, numeric_of
from ..functions.labels import column_label, large_number
from . import wording as w
from .order_statistics import order_statistics, upper_median

# Name hints, patterns, thresholds and limits of the type rules and reports.
TEMPORAL_HINTS = ("date", "time", "month", "day", "quarter", "week", "created", "updated")
TEMPORAL_NAMES = ("year", "fiscal_year", "infra_year")
PERIOD_NAME = "period"
ID_WORD = r"\bid\b"
DATE_START = r"^\d{4}[-/]\d{2}[-/]\d{2}"
YEAR_RANGE = (1900, 2100)
TOP_VALUES = 20
SAMPLES = 5
FILTER_COLUMNS = 5
FILTER_DISTINCT = (2, 50)
# One aggregate over many columns outgrows what the JVM compiles; chunks read their own columns only.
COLUMNS_PER_AGGREGATE = 8
DIGEST = 32  # signs of a digest; a shorter text is never taken for one
BARE_NUMBER = r"^\d+[/.\\]?$"
DOMAINS = (
    ("loan|lend|borrow|credit|debt", "This appears to be a lending/credit dataset."),
    ("revenue|sales|income|profit|expense", "This appears to be a financial performance dataset."),
    ("rate|interest|yield|coupon", "This appears to be an interest rate or financial instrument dataset."),
    ("population|census|demographic", "This appears to be a demographic/population dataset."),
    ("project|infra|construction|flood", "This appears to be an infrastructure/project dataset."),
)
AMBIGUOUS_NAME = r"(?i)amount|^(value|amount|category|label)\s*\d*$|^.{1,3}$"
AMBIGUOUS_SHOWN = 3


def as_text(df: DataFrame, name: str) -> Column:
    """The text form a value is counted under. A double that holds a whole number has no '.0'."""
    dtype = df.schema[name].dataType
    c = col_of(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def _long_form(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """(kept columns…, column, value) for every filled cell."""
    keep = keep or []
    kept = [col_of(k).alias(f"_keep{i}") for i, k in enumerate(keep)]
    texts = df.select(*kept, *[as_text(df, c).alias(c) for c in columns])
    long = texts.unpivot([F.col(f"_keep{i}") for i in range(len(keep))], [col_of(c) for c in columns], "column", "value")
    return long.where((F.col("value") != ""))


def frequency_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, value, count) over the filled cells of the columns."""
    long = _long_form(df, columns or df.columns)
    return long.groupBy("column", "value").agg(F.count("*").alias("count"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, unique_count). Exact by default; the approximate form needs no shuffle of values."""
    columns = columns or df.columns
    if approximate:
        row = df.agg(*[F.approx_count_distinct(F.when(~missing_of(df, c), as_text(df, c))).alias(c) for c in columns])
        return row.unpivot([], [col_of(c) for c in columns], "column", "unique_count")
    return _distinct_table(df, columns).groupBy("column").agg(F.count("*").alias("unique_count"))


def _distinct_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, count) with digests for long values: whole documents need not be shuffled to be told apart.

    Texts shorter than a digest stand for themselves, which takes neither the time nor the bytes of one.
    """
    told = F.when(F.length("value") < DIGEST, F.col("value")).otherwise(F.md5("value"))
    return _long_form(df, columns).groupBy("column", told.alias("value")).agg(F.count("*").alias("count"))


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, null_count, unique_count), one row per column."""
    columns = columns or df.columns
    filled = _distinct_table(df, columns).groupBy("column").agg(
        F.count("*").alias("unique_count"), F.sum("count").alias("filled")
    )
    totals = _one_row_per_column(df.agg(F.count("*").alias("rows")), columns, lambda c: {"rows": F.col("rows")})
    # Two tables with one row per column; a column with no filled cell is missing from the first.
    return totals.join(filled, "column", "left").select(
        "column",
        (F.col("rows") - F.coalesce("filled", F.lit(0))).alias("null_count"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
    )


def _one_row_per_column(row: DataFrame, columns: list[str], fields) -> DataFrame:
    structs = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in fields(c).items()]) for c in columns]
    return row.select(F.inline(F.array(*structs)))


def _number_stats(df: DataFrame, name: str, number: Column) -> tuple[Column, Column, Column]:
    """Least, greatest and sum of the cells that are numbers, as doubles. Decimals are added exactly."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        number = F.when(~F.isnan(number), number)
    return F.min(number).cast("double"), F.max(number).cast("double"), F.sum(number).cast("double")


def column_facts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Everything the type rules look at, one row per column."""
    columns = columns or df.columns
    chunks = [columns[i : i + COLUMNS_PER_AGGREGATE] for i in range(0, len(columns), COLUMNS_PER_AGGREGATE)]
    facts = reduce(DataFrame.unionAll, [_chunk_facts(df, chunk, columns.index(chunk[0])) for chunk in chunks])
    unique = distinct_counts(df, columns, approximate)
    return facts.join(unique, "column", "left").fillna(0, ["unique_count"])


def _chunk_facts(df: DataFrame, columns: list[str], offset: int) -> DataFrame:
    low, high = YEAR_RANGE
    # What the column's own type already says is not parsed out of text again.
    cells, aggregates = [], [F.count("*").alias("rows")]
    zero = F.lit(0).cast("bigint")
    for i, c in enumerate(columns):
        dtype = df.schema[c].dataType
        cell, number = F.col(f"t{i}"), F.col(f"v{i}")
        off_years = F.count_if((number < low) | (number > high))
        broken = F.count_if(number != F.floor(number))
        if isinstance(dtype, (T.NumericType, T.BooleanType)):
            cells += [col_of(c).alias(f"t{i}"), numeric_of(df, c).alias(f"v{i}")]
            measured = (F.count(number), zero, zero, off_years, broken, *_number_stats(df, c, number))
        elif isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            cells.append(col_of(c).alias(f"t{i}"))
            measured = (zero, F.count(cell), zero, zero, zero, *[F.lit(None).cast("double")] * 3)
        else:
            filled = F.when(~missing_of(df, c), as_text(df, c))
            cells += [filled.alias(f"t{i}"), js_number(filled).alias(f"v{i}")]
            dated = F.count_if(cell.rlike(DATE_START))
            length = F.coalesce(F.sum(F.length(cell)), zero)
            measured = (F.count(number), dated, length, off_years, broken, *_number_stats(df, c, number))
        aggregates.append(F.count(cell).alias(f"f{i}"))
        aggregates += [m.alias(f"{k}{i}") for k, m in zip(("n", "d", "l", "y", "x", "lo", "hi", "s"), measured)]
    names = {"f": "filled", "n": "numeric", "d": "dated", "l": "text_length", "y": "off_years", "x": "fractions", "lo": "min", "hi": "max", "s": "sum"}
    index = {c: i for i, c in enumerate(columns)}
    return _one_row_per_column(
        df.select(*cells).agg(*aggregates),
        columns,
        lambda c: {"position": F.lit(offset + index[c]), "rows": F.col("rows"), **{n: F.col(f"{k}{index[c]}") for k, n in names.items()}},
    )


def column_type(strict_ids: bool = False) -> Column:
    """Logical type from the facts; the first rule that holds decides.

    `strict_ids` keeps near-unique measures numeric unless the column holds whole numbers only.
    """
    name = F.lower("column")
    temporal_name = F.lit(False)
    for hint in TEMPORAL_HINTS:
        temporal_name = temporal_name | name.contains(hint)
    temporal_name = temporal_name | name.isin(*TEMPORAL_NAMES)
    rows, filled, unique = F.col("rows"), F.col("filled"), F.col("unique_count")
    mostly_numeric = F.col("numeric") > filled * 0.7
    near_unique = (unique > rows * 0.9) & (rows > 20)
    if strict_ids:
        near_unique = near_unique & (F.col("fractions") == 0)
    mean_length = F.col("text_length") / F.greatest(filled, F.lit(1))
    return (
        F.when(name == PERIOD_NAME, "temporal")
        .when(name.rlike(ID_WORD) & (unique > rows * 0.8), "id")
        .when(temporal_name & (filled > 0) & (filled >= rows * 0.3), "temporal")
        .when(F.col("dated") > filled * 0.5, "temporal")
        .when(mostly_numeric & near_unique, "id")
        .when(mostly_numeric & temporal_name & (F.col("off_years") == 0), "temporal")
        .when(mostly_numeric, "numeric")
        .when((mean_length > 100) | ((unique > rows * 0.8) & (rows > 50)), "text")
        .otherwise("categorical")
    )


def detect_column_types(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, strict_ids: bool = False) -> DataFrame:
    facts = column_facts(df, columns, approximate)
    return facts.select(
        "position", "column", column_type(strict_ids).alias("type"), "unique_count", (F.col("rows") - F.col("filled")).alias("null_count")
    )


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, min, max, sum, mean, median) of the cells that are numbers. The median is the upper one."""
    medians = order_statistics(df, {c: numeric_of(df, c) for c in columns}, {"median": upper_median})
    index = {c: i for i, c in enumerate(columns)}
    aggregates = []
    for i, c in enumerate(columns):
        least, greatest, added = _number_stats(df, c, numeric_of(df, c))
        aggregates += [least.alias(f"lo{i}"), greatest.alias(f"hi{i}"), added.alias(f"s{i}")]

    def fields(c: str) -> dict[str, Column]:
        i, n = index[c], medians[c]["n"]
        return {
            "count": F.lit(n).cast("bigint"),
            "min": F.col(f"lo{i}"),
            "max": F.col(f"hi{i}"),
            "sum": F.col(f"s{i}"),
            "mean": F.try_divide(F.col(f"s{i}"), F.lit(n)),
            "median": F.lit(medians[c]["median"]).cast("double"),
        }

    return _one_row_per_column(df.agg(*aggregates), columns, fields)


def top_values(df: DataFrame, columns: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """(column, rank, value, count): the k most frequent values, ties by value.

    The rank limit is applied in every task before the shuffle by column, so the
    last step sees k rows per column and task, not every distinct value.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = frequency_table(df, columns).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("column", "rank", "value", "count")


def first_values(df: DataFrame, order_by: list[str], columns: list[str] | None = None, k: int = SAMPLES) -> DataFrame:
    """(column, position, value): the first k filled cells of each column in the given row order."""
    columns = columns or [c for c in df.columns if c not in order_by]
    long = _long_form(df, columns, keep=order_by)
    order = Window.partitionBy("column").orderBy(*[F.col(f"_keep{i}").asc_nulls_last() for i in range(len(order_by))], "value")
    ranked = long.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)
    return ranked.select("column", "position", "value")


# --- the collected profile: one small record per column, used to plan reports ----

@dataclass
class ColumnProfile:
    name: str
    type: str
    unique_count: int
    null_count: int
    stats: dict[str, float] = field(default_factory=dict)
    top: list[tuple[str, int]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)

    @property
    def label(self) -> str:
        return column_label(self.name)

    @property
    def sum(self) -> float:
        return self.stats.get("sum") or 0.0


@dataclass
class Profile:
    rows: int
    columns: list[ColumnProfile]

    def of_type(self, kind: str) -> list[ColumnProfile]:
        return [c for c in self.columns if c.type == kind]

    @property
    def numeric(self) -> list[ColumnProfile]:
        return self.of_type("numeric")

    @property
    def categorical(self) -> list[ColumnProfile]:
        return self.of_type("categorical")

    @property
    def temporal(self) -> list[ColumnProfile]:
        return self.of_type("temporal")

    def main_measures(self) -> list[ColumnProfile]:
        """Numeric columns with a positive sum, largest first."""
        return sorted([c for c in self.numeric if c.sum > 0], key=lambda c: -c.sum)


def profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False, order_by: list[str] | None = None, strict_ids: bool = False) -> Profile:
    """Profile a table. What reaches the driver is bounded by the number of columns.

    With `order_by`, the first filled cells of each column in that order are its samples; without, there are none.
    """
    columns = columns or df.columns
    typed = column_facts(df, columns, approximate).withColumn("type", column_type(strict_ids)).orderBy("position").collect()
    rows = typed[0]["rows"] if typed else 0
    out = [ColumnProfile(r["column"], r["type"], r["unique_count"], rows - r["filled"]) for r in typed]
    by_name = {c.name: c for c in out}
    numbers = {r["column"]: r for r in typed if r["type"] == "numeric" and r["numeric"]}
    medians = order_statistics(
        df, {c: numeric_of(df, c) for c in numbers}, {"median": upper_median}, counts={c: r["numeric"] for c, r in numbers.items()}
    )
    for c, r in numbers.items():
        by_name[c].stats = {"min": r["min"], "max": r["max"], "sum": r["sum"], "mean": r["sum"] / r["numeric"], "median": float(medians[c]["median"])}
    categories = [c.name for c in out if c.type == "categorical"]
    if categories:
        for r in top_values(df, categories).orderBy("column", "rank").collect():
            by_name[r["column"]].top.append((r["value"], r["count"]))
    if order_by:
        for r in first_values(df, order_by, columns).orderBy("column", "position").collect():
            by_name[r["column"]].samples.append(r["value"])
    return Profile(rows, out)


# --- filters and context ------------------------------------------------------

def filter_options(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, label, value, count): values worth offering as a filter, for at most five columns."""
    low, high = FILTER_DISTINCT
    # Types come first, one row per column: values are then counted in columns that qualify only.
    found = detect_column_types(df, columns).where((F.col("type") == "categorical") & F.col("unique_count").between(low, high)).collect()
    names = [r["column"] for r in sorted(found, key=lambda r: r["position"])]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, label string, value string, count bigint")
    position = reduce(lambda acc, i: acc.when(F.col("column") == names[i], i), range(len(names)), F.when(F.lit(False), -1))
    usable = top_values(df, names).where((F.length("value") >= 2) & ~F.col("value").rlike(BARE_NUMBER))
    # From here on there are at most twenty rows per column.
    per_column = Window.partitionBy("column")
    offered = usable.withColumns({"position": position, "usable": F.count("*").over(per_column)}).where("usable >= 2")
    first = offered.select("column", "position").distinct().orderBy("position").limit(FILTER_COLUMNS).select("column")
    label = reduce(lambda acc, c: acc.when(F.col("column") == c, column_label(c)), names, F.when(F.lit(False), ""))
    return offered.join(first, "column", "left_semi").select("column", label.alias("label"), "value", "count")


def usable_values(top: list[tuple[str, int]]) -> list[tuple[str, int]]:
    return [(v, n) for v, n in top if len(v) >= 2 and not re.search(BARE_NUMBER, v)]


def context_text(name: str, columns: list[str], profiled: Profile) -> str:
    """The context sentence from a collected profile."""
    words = f"{name} {' '.join(columns)}".lower()
    parts = [next((s for pattern, s in DOMAINS if re.search(pattern, words)), "")]
    unclear = [c for c in profiled.numeric if re.search(AMBIGUOUS_NAME, c.name)][:AMBIGUOUS_SHOWN]
    if unclear:
        shown = [w.CONTEXT_COLUMN.format(name=c.name, low=large_number(c.stats["min"]), high=large_number(c.stats["max"])) for c in unclear]
        parts.append(w.CONTEXT_NOTE.format(columns=", ".join(shown)))
    return " ".join(p for p in parts if p)


def dataset_context(df: DataFrame, name: str, columns: list[str] | None = None) -> DataFrame:
    """One row (dataset, context): the subject area, and a note on numeric columns with unclear names."""
    columns = columns or df.columns
    text = context_text(name, columns, profile(df, columns))
    return df.sparkSession.createDataFrame([(name, text)], "dataset string, context string")
