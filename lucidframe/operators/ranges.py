"""Ranges of a column's values, by which work on one large group or on a whole column is dealt to many tasks.

Bounds are approximate quantiles (bounded memory per task, at most `parts` numbers on the driver). They only deal rows out:
results do not depend on where they lie.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def default_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, value: Column, parts: int | None = None) -> list:
    """Ascending bounds that cut the values (numbers, dates or timestamps) into at most `parts` ranges of about as many rows each."""
    return bounds_of(df, [value], parts)[0]


def bounds_of(df: DataFrame, values: list[Column], parts: int | None = None) -> list[list]:
    """The same for several columns, from one aggregate."""
    parts = parts or default_parts(df)
    if parts < 2 or not values:
        return [[] for _ in values]
    shares = [i / parts for i in range(1, parts)]
    row = df.agg(*(F.percentile_approx(v, shares, max(ACCURACY, 10 * parts)).alias(f"b{i}") for i, v in enumerate(values))).first()
    return [sorted(set(found or [])) for found in row]


def range_index(value: Column, bounds: list) -> Column:
    """How many bounds are at most the value: its range. Null for null. Looks at 2 * sqrt(bounds) numbers per row."""
    if not bounds:
        return F.when(value.isNotNull(), F.lit(0))
    width = isqrt(len(bounds)) + 1
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    firsts = F.array(*(F.lit(b[0]) for b in blocks))
    block = F.size(F.filter(firsts, lambda b: b <= value))
    within = F.element_at(F.array(*(F.array(*map(F.lit, b)) for b in blocks)), F.greatest(block, F.lit(1)))
    index = (F.greatest(block, F.lit(1)) - 1) * width + F.size(F.filter(within, lambda b: b <= value))
    return F.when(value.isNotNull(), F.when(block == 0, F.lit(0)).otherwise(index))
