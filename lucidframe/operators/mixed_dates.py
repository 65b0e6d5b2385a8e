"""Dates of mixed formats in one column: the order of day and month is inferred from the column, invalid and ambiguous cells are marked."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of, strip_spaces

# The formats looked for and the names of months.
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ T].*)?$"
COMPACT = r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$"
DAY_NAME = r"^(\d{1,2})[ -]([A-Za-z]+)[ ,-]+(\d{4})$"
NAME_DAY = r"^([A-Za-z]+)[ -](\d{1,2})[ ,-]+(\d{4})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


@dataclass(frozen=True)
class DateFormats:
    """What a column's cells say: counts by format, and whether numbers give the day first (None: nothing in the column settles it)."""

    year_first: int
    compact: int
    named: int
    day_first_votes: int
    month_first_votes: int
    either: int

    @property
    def day_first(self) -> bool | None:
        if self.day_first_votes == self.month_first_votes:
            return None
        return self.day_first_votes > self.month_first_votes


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _first_two(text: Column) -> tuple[Column, Column]:
    return _part(text, NUMBERS, 1).try_cast("int"), _part(text, NUMBERS, 2).try_cast("int")


def infer_date_formats(df: DataFrame, columns: list[str]) -> dict[str, DateFormats]:
    """The formats of every column, from one aggregate: numbers over 12 vote for the place of the day."""
    parts = []
    for i, c in enumerate(columns):
        text = strip_spaces(col_of(c).cast("string"))
        a, b = _first_two(text)
        counts = {
            "year_first": text.rlike(YEAR_FIRST), "compact": text.rlike(COMPACT), "named": text.rlike(DAY_NAME) | text.rlike(NAME_DAY),
            "day_first_votes": a.between(13, 31) & b.between(1, 12), "month_first_votes": b.between(13, 31) & a.between(1, 12), "either": a.between(1, 12) & b.between(1, 12) & (a != b),
        }
        parts += [F.count_if(condition).alias(f"{name}_{i}") for name, condition in counts.items()]
    row = df.agg(*parts).first().asDict()
    names = list(DateFormats.__dataclass_fields__)
    return {c: DateFormats(*(row[f"{n}_{i}"] for n in names)) for i, c in enumerate(columns)}


def _day(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where there is no such day."""
    two = lambda part: F.lpad(part.cast("string"), 2, "0")
    return F.concat(year, F.lit("-"), two(month), F.lit("-"), two(day)).try_cast("date")


def _month(name: Column) -> Column:
    """The number of a month's name or of its first three letters or more, or null."""
    low = F.lower(name)
    found = F.filter(F.transform(F.array(*map(F.lit, MONTHS)), lambda m, i: F.when(m.startswith(low) & (F.length(low) >= 3), i + 1)), lambda i: i.isNotNull())
    return F.get(found, F.lit(0))


def parsed_date(c: Column, formats: DateFormats, day_first: bool = False) -> Column:
    """(date, status) of a cell. `day_first` decides where the column does not.

    missing: null or blank. parsed. ambiguous: day and month could be either way round and nothing in the column settles it; the date
    is that of `day_first`. invalid: the form of a date, but no such day. unknown: no date at all.
    """
    text = strip_spaces(c.cast("string"))
    order = formats.day_first if formats.day_first is not None else day_first
    a, b = _first_two(text)
    year = _part(text, NUMBERS, 3)
    by_column = _day(year, b, a) if order else _day(year, a, b)
    # A number over 12 is the day, whatever the column says.
    numbers = F.when(a > 12, _day(year, b, a)).when(b > 12, _day(year, a, b)).otherwise(by_column)
    three = lambda pattern: tuple(_part(text, pattern, i) for i in (1, 2, 3))
    y1, m1, d1 = three(YEAR_FIRST)
    y2, m2, d2 = three(COMPACT)
    d3, m3, y3 = three(DAY_NAME)
    m4, d4, y4 = three(NAME_DAY)
    forms = [(YEAR_FIRST, _day(y1, m1, d1)), (COMPACT, _day(y2, m2, d2)), (NUMBERS, numbers), (DAY_NAME, _day(y3, _month(m3), d3)), (NAME_DAY, _day(y4, _month(m4), d4))]
    day, status = F.lit(None).cast("date"), F.lit("unknown")
    for pattern, value in reversed(forms):
        day = F.when(text.rlike(pattern), value).otherwise(day)
        status = F.when(text.rlike(pattern), F.when(value.isNull(), "invalid").otherwise("parsed")).otherwise(status)
    if formats.day_first is None:
        status = F.when((a <= 12) & (b <= 12) & (a != b) & numbers.isNotNull(), "ambiguous").otherwise(status)
    status = F.when(text.isNull() | (text == ""), "missing").otherwise(status)
    return F.struct(day.alias("date"), status.alias("status"))


def parse_dates(df: DataFrame, columns: list[str], day_first: bool = False) -> DataFrame:
    """`df` with `<column>_date` and `<column>_status` for every given column."""
    formats = infer_date_formats(df, columns)
    out = df
    for c in columns:
        out = out.withColumn(f"__{c}", parsed_date(col_of(c), formats[c], day_first))
    return out.select(*(col_of(c) for c in df.columns), *(p for c in columns for p in (col_of(f"__{c}")["date"].alias(f"{c}_date"), col_of(f"__{c}")["status"].alias(f"{c}_status"))))
