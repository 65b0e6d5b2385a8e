"""Display text: large numbers, period names, column names, file slugs."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit steps, and decimals per unit for each label style (B, M, K, plain).
UNITS = ((1e9, "B"), (1e6, "M"), (1e3, "K"))
STYLES = {
    "plain": {"prefix": "", "decimals": (2, 1, 1, 2), "signed": True, "keep_integers": True},
    "currency": {"prefix": "₱", "decimals": (2, 1, 0, 0), "signed": False, "keep_integers": False},
    "axis": {"prefix": "", "decimals": (1, 1, 1, 1), "signed": True, "keep_integers": True},
}


def fixed(c: Column, digits: int) -> Column:
    """Number as text with a fixed count of decimals and no separators."""
    return F.round(c, digits).cast(f"decimal(30,{digits})").cast("string")


def format_large_number(c: Column, style: str = "plain") -> Column:
    s = STYLES[style]
    v = c.cast("double")
    size = F.abs(v) if s["signed"] else v
    label = None
    for (step, unit), digits in zip(UNITS, s["decimals"]):
        text = F.concat(fixed(v / step, digits), F.lit(unit))
        label = F.when(size >= step, text) if label is None else label.when(size >= step, text)
    if s["keep_integers"]:
        label = label.when(v == F.floor(v), v.cast("decimal(30,0)").cast("string"))
    label = label.otherwise(fixed(v, s["decimals"][3]))
    return F.concat(F.lit(s["prefix"]), label) if s["prefix"] else label


def to_fixed(value: float, digits: int) -> str:
    """Fixed decimals, halves away from zero, for a number on the driver."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def large_number(value: float) -> str:
    """The plain style of `format_large_number` for a number on the driver."""
    value = float(value)
    for (step, unit), digits in zip(UNITS, STYLES["plain"]["decimals"]):
        if abs(value) >= step:
            return to_fixed(value / step, digits) + unit
    return str(int(value)) if value == int(value) else to_fixed(value, STYLES["plain"]["decimals"][3])


def signed_percent(value: float, digits: int) -> str:
    return ("+" if value >= 0 else "") + to_fixed(value, digits) + "%"


def period_label(c: Column) -> Column:
    """'2018 31' becomes '2018 P31'; anything else is only trimmed."""
    return F.regexp_replace(F.trim(c), r"^(\d{4})\s+(\d+)$", "$1 P$2")


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"))


def column_label(name: str) -> str:
    """Readable column name; this one works on the schema, so it is plain Python."""
    text = name.strip()
    if re.fullmatch(r"\d{4}", text):
        return text
    if re.fullmatch(r"\d{4}\s+\d+", text):
        return " P".join(text.split())
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"[_-]", " ", name))
    return re.sub(r"\b[a-z]", lambda m: m.group().upper(), spaced).strip()


def column_label_of(c: Column) -> Column:
    """The same naming rule for names held in a column."""
    text = F.trim(c)
    spaced = F.regexp_replace(F.regexp_replace(c, "[_-]", " "), "([a-z])([A-Z])", "$1 $2")
    # Cut in front of every word start, raise the first letter, glue together again.
    words = F.transform(
        F.split(F.trim(spaced), r"(?<=\W)(?=\w)"),
        lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2))),
    )
    return F.when(text.rlike(r"^\d{4}(\s+\d+)?$"), period_label(text)).otherwise(F.array_join(words, ""))


def dataset_title(file_name: str) -> str:
    stem = re.sub(r"\.[^.]+$", "", file_name)
    return re.sub(r"\b\w", lambda m: m.group().upper(), re.sub(r"[_-]", " ", stem))
