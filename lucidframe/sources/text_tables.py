"""Tables inside plain text: detect the column separator of each document and read its cells.

A document is one row, so everything is decided inside the row with array
functions: no shuffle, and a corpus of any size runs as one narrow stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import SPACE_CLASS, SPACES, js_number, strip_spaces

# Fixed values, in the order in which separators are tried: name, pattern, least
# share of lines that hold it, lines searched for a header, whether a header
# needs a letter, least count of lines.
SEPARATORS = (
    ("tab", "\t", 0.4, 5, False, 2),
    ("comma", ",", 0.4, 5, False, 2),
    ("pipe", r"\|", 0.4, 5, False, 2),
    ("spaces", SPACE_CLASS + "{3,}", 0.3, 8, True, 2),
    ("double_space", SPACE_CLASS + "{2,}", 0.0, None, True, 3),
)
LEAST_PARTS = 2


def text_lines(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip_spaces), lambda line: line != "")


def _parts(line: Column, pattern: Column | str) -> Column:
    return F.transform(F.split(line, pattern, -1), lambda part: F.btrim(part, F.lit(SPACES)))


def _filled(line: Column, pattern: Column | str) -> Column:
    return F.filter(_parts(line, pattern), lambda part: part != "")


def _is_row(line: Column, pattern: Column | str) -> Column:
    return F.size(_filled(line, pattern)) >= LEAST_PARTS


# What a line is to a separator; every later fact about a document is read from these.
_WITHOUT, _HOLDS, _ROW, _HEADER = range(4)


def _marks(lines: Column, pattern: str, letter: bool) -> Column:
    """For each line whether it holds the separator, is a row and can be a header. Only lines that hold it are split, once."""

    def mark(line: Column) -> Column:
        out = F.when(~line.rlike(pattern), _WITHOUT).when(~_is_row(line, pattern), _HOLDS)
        return (out.when(~line.rlike("[a-zA-Z]"), _ROW) if letter else out).otherwise(_HEADER)

    return F.transform(lines, mark)


def detect_tables(documents: DataFrame, text: str = "text") -> DataFrame:
    """Adds `lines` (array), and for documents with a table `separator`, `pattern` and `header_at` (1-based line)."""
    df = documents.withColumn("lines", text_lines(F.col(text)))
    lines, count = F.col("lines"), F.size("lines")
    found = F.lit(None).cast("struct<separator:string,pattern:string,header_at:bigint>")
    df = df.withColumn("_table", found)
    for name, pattern, least_share, within, letter, least_lines in SEPARATORS:
        # Lines are looked at only where no earlier separator has made a table and the text holds this one at all.
        df = df.withColumn("_marks", F.when(F.col("_table").isNull() & F.col(text).rlike(pattern), _marks(lines, pattern, letter)))
        marks = F.col("_marks")
        at = F.array_position(F.slice(marks, F.lit(1), F.lit(within)) if within else marks, F.lit(_HEADER))
        below = F.slice(marks, (at + 1).cast("int"), F.greatest(count, F.lit(1)))
        often = F.size(F.filter(marks, lambda m: m >= _HOLDS)) >= count * least_share
        fits = (count >= least_lines) & (at > 0) & often & F.exists(below, lambda m: m >= _ROW)
        df = df.withColumn("_table", F.coalesce("_table", F.when(fits, F.struct(F.lit(name).alias("separator"), F.lit(pattern).alias("pattern"), at.alias("header_at")))))
    return df.withColumns({k: F.col(f"_table.{k}") for k in ("separator", "pattern", "header_at")}).drop("_table", "_marks")


def table_shapes(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_count, separator, header_at, headers, row_count) of every document; no table gives nulls."""
    header = F.element_at("lines", F.col("header_at").cast("int"))
    rows = F.filter(_below_header(), lambda line: _is_row(line, F.col("pattern")))
    return detected.select(
        key, F.size("lines").alias("line_count"), "separator", (F.col("header_at") - 1).cast("int").alias("header_line"),
        F.when(F.col("separator").isNotNull(), F.array_join(_filled(header, F.col("pattern")), " / ")).alias("headers"),
        F.when(F.col("separator").isNotNull(), F.size(rows)).alias("row_count"),
    )


def _below_header() -> Column:
    return F.slice(F.col("lines"), (F.col("header_at") + 1).cast("int"), F.greatest(F.size("lines"), F.lit(1)))


def table_cells(detected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, row, col, header, value, number) for every cell of every detected table.

    Rows are lines below the header with two or more filled parts. A cell that
    is a number once its commas are gone has it in `number`.
    """
    pattern = F.col("pattern")
    rows = F.filter(F.transform(_below_header(), lambda line: _parts(line, pattern)), lambda parts: F.size(F.filter(parts, lambda p: p != "")) >= LEAST_PARTS)
    header = F.element_at("lines", F.col("header_at").cast("int"))
    # Outer explodes, filtered afterwards: a filter on the detection itself would be
    # pushed below it and run the whole detection a second time.
    by_row = detected.select(F.col(key), _filled(header, pattern).alias("headers"), F.posexplode_outer(rows).alias("row", "parts")).where("row IS NOT NULL")
    # A row may have fewer parts than headers: `get` gives null beyond the end.
    cells = F.transform(F.col("headers"), lambda h, i: F.struct(h.alias("header"), F.get(F.col("parts"), i).alias("value")))
    by_cell = by_row.select(key, "row", F.posexplode_outer(cells).alias("col", "cell"))
    value = F.when(F.col("cell.value") != "", F.col("cell.value"))
    return by_cell.select(
        key, "row", "col", F.col("cell.header").alias("header"), value.alias("value"), js_number(F.replace(value, F.lit(","), F.lit(""))).alias("number")
    )
