"""What a text column holds beyond its type: e-mail addresses, telephone numbers, URLs and so on, by the rate of cells that pass a validator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import CURRENCY_MARKS, strip_spaces
from ..functions.dates import tolerant_date
from .profile import _long_form

# Patterns of the validators, words for yes and no, and the rates of high, medium and low confidence.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
URL = r"^(https?|ftp)://[A-Za-z0-9.-]+(:\d+)?([/?#]\S*)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"
PHONE = r"^(\+\d[\d ().-]*|\(?\d+[ ).-][\d ().-]*)$"
CARD = r"^\d[\d -]*$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
COORDINATES = r"^[+-]?\d{1,3}\.\d+\s*[,;]\s*[+-]?\d{1,3}\.\d+$"
PERCENT = r"^[+-]?\d+(\.\d+)?\s?%$"
CURRENCY = rf"^[-(]?[{CURRENCY_MARKS}]\s?\d{{1,3}}(,?\d{{3}})*(\.\d+)?\)?$"
BOOLEANS = ("true", "false", "yes", "no", "y", "n")
CONFIDENCE = (("high", 0.95), ("medium", 0.8), ("low", 0.5))


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    places = F.sequence(F.lit(1), F.length(digits))
    values = F.transform(places, lambda i: F.substr(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda s, v: s + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def validators(text: Column) -> dict[str, Column]:
    """The kinds, most telling first, and whether a cell is of one."""
    digits = F.regexp_replace(text, r"\D", "")
    count = F.length(digits)
    # A pair in range, latitude first.
    pair = F.transform(F.split(F.regexp_replace(text, r"\s", ""), "[,;]"), lambda p: F.abs(p.try_cast("double")))
    card = text.rlike(CARD) & count.between(13, 19)
    return {
        "uuid": text.rlike(UUID),
        "email": text.rlike(EMAIL),
        "url": text.rlike(URL),
        "ip_address": text.rlike(IPV4),
        "card_number": F.when(card, luhn(digits)).otherwise(F.lit(False)),
        "coordinates": F.when(text.rlike(COORDINATES), (pair[0] <= 90) & (pair[1] <= 180)).otherwise(F.lit(False)),
        "date": tolerant_date(text).isNotNull(),
        "phone": text.rlike(PHONE) & count.between(7, 15),
        "currency": text.rlike(CURRENCY),
        "percent": text.rlike(PERCENT),
        "boolean": F.lower(text).isin(*BOOLEANS),
    }


def semantic_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, filled, semantic_type, matching, rate, confidence), one row per column.

    A column is of the kind that most of its filled cells pass, the more telling of equals; its confidence follows the rate. Below
    the lowest rate, or without filled cells, it is plain `text` with no confidence. All columns and validators share one scan with
    one row per column and task behind it, whatever the number of columns.
    """
    columns = columns or df.columns
    long = _long_form(df, columns).select("column", strip_spaces(F.col("value")).alias("text")).where("text <> ''")
    kinds = validators(F.col("text"))
    counted = long.groupBy("column").agg(F.count("*").alias("filled"), *(F.count_if(passes).alias(kind) for kind, passes in kinds.items()))
    ranked = F.array_max(F.array(*(F.struct(F.col(kind).alias("matching"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, kind in enumerate(kinds))))
    rate = F.col("best.matching") / F.col("filled")
    confidence = F.lit(None).cast("string")
    for name, least in reversed(CONFIDENCE):
        confidence = F.when(rate >= least, name).otherwise(confidence)
    told = counted.select("column", "filled", ranked.alias("best")).withColumn("confidence", confidence)
    told = told.select("column", "filled", F.when(F.col("confidence").isNull(), "text").otherwise(F.col("best.kind")).alias("semantic_type"), F.col("best.matching").alias("matching"), rate.alias("rate"), "confidence")
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return named.join(told, "column", "left").na.fill({"filled": 0, "semantic_type": "text", "matching": 0})
