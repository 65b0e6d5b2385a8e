"""Tolerant date parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_date(c: Column) -> Column:
    """Year-month-day text (with - or /) to a date; null when it is not a real day."""
    text = F.regexp_replace(F.trim(c.cast("string")), "/", "-")
    # A time part after the day is allowed, as in '2021-03-04 10:00:00'.
    day = F.regexp_extract(text, r"^(\d{4}-\d{1,2}-\d{1,2})([ T].*)?$", 1)
    return F.when(day != "", day.try_cast("date"))


def epoch_ms_date(c: Column) -> Column:
    """The UTC day of a time in milliseconds, whatever the session's time zone is."""
    day = F.lit(86_400_000).cast("bigint")
    return F.date_from_unix_date(((c - F.pmod(c, day)) / day).cast("int"))
