"""Column helpers for numbers, blanks and whitespace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a plain number, as whitespace and as a currency mark.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SPACE_CLASS = r"[\s\x0b\p{Z}\x{feff}]"
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CURRENCY_MARKS = "$₱€£"
NULL_WORDS = ("null", "undefined")


def strip_spaces(c: Column) -> Column:
    """Trim every kind of whitespace, not only the space character."""
    return F.btrim(c, F.lit(SPACES))


def squeeze_spaces(c: Column) -> Column:
    """Trim, and turn each inner run of whitespace into one space."""
    return strip_spaces(F.regexp_replace(c, f"{SPACE_CLASS}+", " "))


def js_number(c: Column) -> Column:
    """Text to double, or null. Spark's own cast also takes '1d', 'inf' and 'NaN'; those stay text here."""
    text = strip_spaces(c.cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def is_numeric_text(c: Column) -> Column:
    return F.coalesce(strip_spaces(c.cast("string")).rlike(NUMBER_PATTERN), F.lit(False))


def is_missing(c: Column, rule: str = "empty") -> Column:
    """Missing cells under one of three rules.

    null   only null
    empty  null or ''
    blank  null, or nothing but whitespace
    """
    if rule == "null":
        return c.isNull()
    text = c.cast("string")
    if rule == "empty":
        return c.isNull() | (text == "")
    if rule == "blank":
        return c.isNull() | (strip_spaces(text) == "")
    raise ValueError(f"unknown missing rule: {rule}")


def missing_of(df: DataFrame, name: str) -> Column:
    """Null or empty, by the column's type: only text can be empty."""
    c = col_of(name)
    return is_missing(c) if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()


def group_key(c: Column, null_words: bool = True) -> Column:
    """Trimmed text of a grouping cell; null where the cell must not form a group.

    Chart groupings also leave out the words 'null' and 'undefined'; insights count them.
    """
    text = strip_spaces(c.cast("string"))
    keep = text != ""
    if null_words:
        keep = keep & ~text.isin(*NULL_WORDS)
    return F.when(keep, text)


def numeric_of(df: DataFrame, name: str) -> Column:
    """A column as a number: itself if numeric, 0/1 for booleans, parsed if text."""
    dtype = df.schema[name].dataType
    c = F.col(quoted(name))
    if isinstance(dtype, T.NumericType):
        return c
    if isinstance(dtype, T.BooleanType):
        return c.cast("int")
    return js_number(c)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col_of(name: str) -> Column:
    return F.col(quoted(name))


def total(c: Column) -> Column:
    """Sum as a double. Decimal input is added exactly, so the result does not depend on task order."""
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def cents(c: Column) -> Column:
    """Money as an exact decimal with two places."""
    return c.cast("decimal(18,2)")


def money_total(c: Column) -> Column:
    return F.sum(cents(c)).cast("double")


def percent_number(c: Column) -> Column:
    """'12.5%' to 0.125; null for any other text."""
    text = strip_spaces(c)
    return F.when(text.endswith("%"), js_number(F.regexp_replace(text, "%$", "")) / 100)


def currency_number(c: Column) -> Column:
    """'$1,234.50' to 1234.5; null where the text has no mark or is not fully numeric without the marks."""
    marked = c.rlike(f"[{CURRENCY_MARKS},]")
    return F.when(marked, js_number(F.regexp_replace(c, f"[{CURRENCY_MARKS},]", "")))


def number_text(c: Column) -> Column:
    """A double as short text: whole numbers without a decimal point."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def cleaned_number(c: Column) -> Column:
    """The number in a percent or currency string, percent first; null for other text."""
    return F.coalesce(percent_number(c), currency_number(c))
