"""Exact order statistics of many columns at once.

An exact quantile normally means sorting a column or holding all its values in
one task. Here every requested position of every column is answered by the same
few scans:

1. each position is bracketed by approximate quantiles (bounded memory per task);
2. one aggregate counts how many values lie below, on and between the bracket
   ends, which fixes the position exactly or leaves a much smaller open range;
3. ranges of at most `gathered` values in all are sorted and read off; wider ones
   are bracketed again.

Values are compared in their column's own type, so large integers and decimals
keep all their digits. Only counts and bracket ends (a few numbers per request)
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Positions, as 0-based index into the n sorted values of a column.
def lower_quartile(n: int) -> int:
    return n // 4


def upper_median(n: int) -> int:
    return n // 2


def upper_quartile(n: int) -> int:
    return 3 * n // 4


# So many values at most are gathered and sorted for all positions together, in one task.
GATHERED = 50_000
ACCURACY = 10_000


@dataclass
class _Search:
    """One requested position and the open range (low, high) it is known to lie in."""

    column: Column
    index: int
    size: int
    low: int | float | Decimal | None = None
    high: int | float | Decimal | None = None
    answer: int | float | Decimal | None = None
    stuck: bool = False

    def inside(self) -> Column:
        condition = self.column.isNotNull()
        if self.low is not None:
            condition = condition & (self.column > self.low)
        if self.high is not None:
            condition = condition & (self.column < self.high)
        return condition


def order_statistics(
    df: DataFrame,
    columns: dict[str, Column],
    positions: dict[str, Callable[[int], int]],
    gathered: int = GATHERED,
    accuracy: int = ACCURACY,
    counts: dict[str, int] | None = None,
) -> dict[str, dict[str, int | float | Decimal | None]]:
    """For each named numeric column: its count `n`, and the value at each named position, in the column's own type.

    Nulls and NaN are left out. Reads `df` a few times, so hand in a table or a
    persisted frame rather than a long chain. Counts of the values, where known,
    save the first pass.
    """
    if not columns:
        return {}
    types = df.select(*[c.alias(f"v{i}") for i, c in enumerate(columns.values())]).schema
    values = {}
    for i, (name, c) in enumerate(columns.items()):
        kind = types[f"v{i}"].dataType
        if isinstance(kind, T.IntegralType):
            values[name] = c.cast("bigint")
        elif isinstance(kind, T.DecimalType):
            values[name] = c
        else:
            v = c.cast("double")
            values[name] = F.when(~F.isnan(v), v)

    names = list(columns)
    frame = df.select(*[values[name].alias(f"v{i}") for i, name in enumerate(names)])
    cols = {name: F.col(f"v{i}") for i, name in enumerate(names)}
    if counts is None:
        row = frame.agg(*[F.count(cols[name]).alias(f"n{i}") for i, name in enumerate(names)]).first()
        counts = {name: row[f"n{i}"] for i, name in enumerate(names)}

    out: dict[str, dict[str, float | int | None]] = {}
    searches: dict[tuple[str, str], _Search] = {}
    for name in names:
        n = counts[name]
        out[name] = {"n": n, **{p: None for p in positions}}
        for p, position in positions.items():
            if n:
                searches[name, p] = _Search(cols[name], position(n), n)

    while open_searches := [s for s in searches.values() if s.answer is None]:
        _narrow(frame, open_searches, accuracy)
        left = [s for s in open_searches if s.answer is None]
        small = [s for s in left if s.size <= max(1, gathered // len(left))]
        if small:
            _read_off(frame, small)

    for (name, p), s in searches.items():
        out[name][p] = s.answer
    return out


def _read_off(frame: DataFrame, searches: list[_Search]) -> None:
    row = frame.agg(*[F.sort_array(F.collect_list(F.when(s.inside(), s.column)))[s.index].alias(f"a{i}") for i, s in enumerate(searches)]).first()
    for i, s in enumerate(searches):
        s.answer = row[f"a{i}"]


def _narrow(frame: DataFrame, searches: list[_Search], accuracy: int) -> None:
    slack = 3.0 / accuracy
    wanted = []
    for i, s in enumerate(searches):
        c, at = F.when(s.inside(), s.column), (s.index + 0.5) / s.size
        ends = F.percentile_approx(c, [max(0.0, at - slack), min(1.0, at + slack)], accuracy)
        wanted += [ends.alias(f"b{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    row = frame.agg(*wanted).first()
    # Approximate quantiles go through doubles: they are kept inside the range, which is halved where they part it badly.
    brackets = []
    for i, s in enumerate(searches):
        least, most = row[f"lo{i}"], row[f"hi{i}"]
        brackets.append((_middle(least, most),) * 2 if s.stuck else tuple(min(max(end, least), most) for end in row[f"b{i}"]))

    parts_of = []
    for i, (s, (lo, hi)) in enumerate(zip(searches, brackets)):
        c, inside = s.column, s.inside()
        parts_of += [
            F.count_if(inside & (c < lo)).alias(f"below{i}"),
            F.count_if(inside & (c == lo)).alias(f"on_lo{i}"),
            F.count_if(inside & (c > lo) & (c < hi)).alias(f"between{i}"),
            F.count_if(inside & (c == hi) & (c > lo)).alias(f"on_hi{i}"),
        ]
    row = frame.agg(*parts_of).first()

    for i, (s, (lo, hi)) in enumerate(zip(searches, brackets)):
        # Walk over the five parts of the range; whichever holds the position decides.
        index = s.index
        parts = [
            (row[f"below{i}"], s.low, lo, None),
            (row[f"on_lo{i}"], None, None, lo),
            (row[f"between{i}"], lo, hi, None),
            (row[f"on_hi{i}"], None, None, hi),
        ]
        rest = s.size - sum(p[0] for p in parts)
        parts.append((rest, hi, s.high, None))
        for size, low, high, answer in parts:
            if index < size:
                if answer is not None:
                    s.answer = answer
                else:
                    s.stuck = 2 * size > s.size
                    s.index, s.size, s.low, s.high = index, size, low, high
                break
            index -= size


def _middle(low: int | float | Decimal, high: int | float | Decimal) -> int | float | Decimal:
    if isinstance(low, int):
        return (low + high) // 2
    if isinstance(low, Decimal):
        return (low + (high - low) / 2).quantize(low)
    return low + (high - low) / 2
