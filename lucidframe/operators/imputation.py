"""Filling missing cells: carried forward or backward within an entity, or by its mean, median or mode. Ids are never filled.

An entity may hold any share of the rows. Its rows are dealt out by ranges of their order, every range carries the last filled
value to its own rows, one aggregate gives the last filled value of each (entity, range), and a prefix pass over the ranges,
of which an entity has a bounded number, tells every range what it starts with. Medians find their range by counts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import col_of, missing_of, numeric_of
from .profile import detect_column_types
from .ranges import range_bounds, range_index

_BY, _RANGE = "__by", "__range"


class IdentifierError(ValueError):
    """An identifier must not be filled."""


def identifiers(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of `columns` that are ids by the rules of the profile."""
    return [r.column for r in detect_column_types(df, columns, approximate=True, strict_ids=True).where("type = 'id'").collect()]


def _checked(df: DataFrame, columns: list[str], ids: list[str] | None) -> None:
    refused = [c for c in columns if c in (identifiers(df, columns) if ids is None else ids)]
    if refused:
        raise IdentifierError(f"ids are never filled: {', '.join(refused)}")


def _filled(df: DataFrame, name: str) -> Column:
    return F.when(~missing_of(df, name), col_of(name))


def drop_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in which all of `columns` are filled."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & ~missing_of(df, c)
    return df.where(condition)


def carry(df: DataFrame, columns: list[str], by: list[str], order: list[str], backward: bool = False, ids: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """`df` with the missing cells of `columns` taken from the row before (after, if `backward`) that has one, within its entity.

    `by` names the entity, null being one of its values; `order` must order an entity's rows wholly, its first column being a
    number, date or timestamp. Rows in which that is null have no place: they neither give nor take. `ids` are the identifiers
    (found by the profile's rules if not given); naming one in `columns` is an error. Cells with nothing before them stay missing.
    """
    _checked(df, columns, ids)
    first = col_of(order[0])
    rows = df.select("*", F.struct(*(col_of(b) for b in by)).alias(_BY), range_index(first, range_bounds(df, first, parts)).alias(_RANGE))
    values = {f"__v{i}": _filled(df, c) for i, c in enumerate(columns)}
    place = F.struct(*(col_of(o) for o in order))
    direction = (lambda name: col_of(name).desc()) if backward else col_of
    within = Window.partitionBy(_BY, _RANGE).orderBy(*(direction(o) for o in order)).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.min_by if backward else F.max_by
    ends = rows.where(F.col(_RANGE).isNotNull()).groupBy(_BY, _RANGE)
    ends = ends.agg(*(pick(v, F.when(v.isNotNull(), place)).alias(n) for n, v in values.items()))
    earlier = Window.partitionBy(_BY).orderBy(F.col(_RANGE).desc() if backward else F.col(_RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(_BY, _RANGE, *(F.last(n, ignorenulls=True).over(earlier).alias(n) for n in values))
    near = rows.select("*", *(F.last(v, ignorenulls=True).over(within).alias(f"{n}n") for n, v in values.items()))
    joined = near.join(ends, [_BY, _RANGE], "left")
    taken = {c: F.when(F.col(_RANGE).isNull(), col_of(c)).otherwise(F.coalesce(F.col(f"__v{i}n"), F.col(f"__v{i}"), col_of(c))) for i, c in enumerate(columns)}
    return joined.select(*(taken[c].alias(c) if c in taken else col_of(c) for c in df.columns))


def _modes(rows: DataFrame, value: Column) -> DataFrame:
    counts = rows.select(_BY, value.alias("value")).where("value IS NOT NULL").groupBy(_BY, "value").agg(F.count("*").alias("n"))
    return counts.groupBy(_BY).agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("found"))


def _means(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy(_BY).agg(F.try_divide(F.sum(value).cast("double"), F.count(value)).alias("found"))


def _medians(rows: DataFrame, value: Column, parts: int | None) -> DataFrame:
    """(entity, upper median): the range that holds it by counts per range, then the values of that range alone."""
    ranged = rows.select(_BY, value.alias("value")).where("value IS NOT NULL")
    ranged = ranged.withColumn(_RANGE, range_index(F.col("value"), range_bounds(ranged, F.col("value"), parts)))
    counts = ranged.groupBy(_BY, _RANGE).agg(F.count("*").alias("n"))
    so_far, whole = Window.partitionBy(_BY).orderBy(_RANGE), Window.partitionBy(_BY)
    counts = counts.select(_BY, _RANGE, "n", F.sum("n").over(so_far).alias("upto"), F.floor(F.sum("n").over(whole) / 2).alias("at"))
    held = counts.where("at < upto AND at >= upto - n").select(_BY, _RANGE, (F.col("at") - F.col("upto") + F.col("n")).alias("at"))
    values = ranged.join(held, [_BY, _RANGE]).groupBy(_BY, "value").agg(F.count("*").alias("n"), F.first("at").alias("at"))
    reached = values.select(_BY, "value", "at", F.sum("n").over(Window.partitionBy(_BY).orderBy("value")).alias("upto"))
    return reached.where("upto > at").groupBy(_BY).agg(F.min("value").alias("found"))


def fill_by_group(df: DataFrame, how: dict[str, str], by: list[str], ids: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """`df` with the missing cells of each column of `how` filled by its group's mean, median (the upper one) or mode (the least of equals).

    `by` may be empty: then the whole table is one group. Means give doubles. A group without a filled cell keeps its gaps.
    """
    _checked(df, list(how), ids)
    out = rows = df.select("*", F.struct(F.lit(0).alias("all"), *(col_of(b) for b in by)).alias(_BY))
    for i, (c, kind) in enumerate(how.items()):
        value = _filled(df, c) if kind == "mode" else numeric_of(df, c)
        if kind == "median":
            found = _medians(rows, value, parts)
        else:
            found = {"mean": _means, "mode": _modes}[kind](rows, value)
        out = out.join(found.withColumnRenamed("found", f"__f{i}"), _BY, "left")
    taken = {}
    for i, (c, kind) in enumerate(how.items()):
        own = numeric_of(df, c).cast("double") if kind == "mean" else _filled(df, c)
        taken[c] = F.coalesce(own, F.col(f"__f{i}"))
    return out.select(*(taken[c].alias(c) if c in taken else col_of(c) for c in df.columns))
