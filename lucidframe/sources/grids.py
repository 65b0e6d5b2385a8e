"""Raw cell grids: find each sheet's header row, compose its headers, read its data.

Input is long, one row per cell: (sheet_id, row_idx, col_idx, value). One
aggregate by row brings its cells together, one by sheet its first rows (a few
times the sheet's width, however long it is); all header work follows with array
functions on that one row per sheet, so nothing is sorted or shuffled for it.
First rows that are data meet their names there too, so their cells travel once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import NUMBER_PATTERN, js_number, strip_spaces
from ..session import kept

# Rows searched, year range, score weights, header limits.
HEADER_ROWS = 10
SEARCHED_ROWS = HEADER_ROWS + 2
HEADER_YEARS = (1900, 2099)
TITLE_BONUS, BONUS_ROWS = 3, (1, 3)
DATA_NUMBERS = 2
LEAST_CELLS, LEAST_ROWS = 2, 3
SUBHEADER_NUMERIC = 0.5
GARBAGE_SHARE, GARBAGE_COLUMNS, GARBAGE_LENGTH = 0.4, 3, 2


def _filled(c: Column) -> Column:
    return F.coalesce(strip_spaces(c) != "", F.lit(False))


def _numeric(c: Column) -> Column:
    return F.coalesce(strip_spaces(c).rlike(NUMBER_PATTERN), F.lit(False))


def _year(c: Column) -> Column:
    n = js_number(c)
    return F.coalesce((n == F.floor(n)) & n.between(*HEADER_YEARS), F.lit(False))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, filled, numeric, years, last_col, written, columns, values): every row of a sheet in one row.

    Its cells are two arrays, a third of the bytes that an array of structs takes.
    """
    v = F.col("value")
    rows = cells.groupBy("sheet_id", "row_idx").agg(
        F.count_if(_filled(v)).alias("filled"),
        F.count_if(_numeric(v)).alias("numeric"),
        F.count_if(_year(v)).alias("years"),
        F.max("col_idx").alias("last_col"),
        F.count_if(F.coalesce(v != "", F.lit(False))).alias("written"),
        F.collect_list(F.struct("col_idx", "value")).alias("line"),
    )
    return rows.select("*", F.col("line")["col_idx"].alias("columns"), F.col("line")["value"].alias("values")).drop("line")


def _cells_of(columns: Column | str, values: Column | str) -> Column:
    """The two arrays of a row as one of (col_idx, value)."""
    return F.zip_with(columns, values, lambda c, v: F.struct(c.alias("col_idx"), v.alias("value")))


def _score(row: Column) -> Column:
    """The score of a row as header; null for a row that cannot be one."""
    texts, plain_numbers = row["filled"] - row["numeric"], row["numeric"] - row["years"]
    data_like = (plain_numbers > DATA_NUMBERS) & (texts > 0) & (plain_numbers >= texts)
    bonus = F.when(row["row_idx"].between(*BONUS_ROWS), TITLE_BONUS).otherwise(0)
    usable = (row["row_idx"] < HEADER_ROWS) & (row["filled"] >= LEAST_CELLS) & ~data_like
    return F.when(usable, (texts + row["years"]) * 2 + row["filled"] + bonus)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _head(*cells: Column | str) -> Column:
    # Cells up to the row's last one that are empty or not in the table at all.
    gaps = (F.col("last_col") + 1 - F.col("written")).alias("gaps")
    return F.struct("row_idx", "filled", "numeric", "years", gaps, *cells)


def _heads(rows: DataFrame) -> DataFrame:
    """(sheet_id, head, last, width): the first rows of each sheet, its last row and its last column.

    The cells travel only of rows that may turn out as header or sub-header.
    """
    row = F.struct("row_idx", "filled", "numeric", "years")
    may_matter = _score(row).isNotNull() | (F.col("numeric") < F.col("filled") * SUBHEADER_NUMERIC)
    first = F.when(F.col("row_idx") < SEARCHED_ROWS, _head(*(F.when(may_matter, F.col(c)).alias(c) for c in ("columns", "values"))))
    return rows.groupBy("sheet_id").agg(F.collect_list(first).alias("head"), F.max("row_idx").alias("last"), F.max("last_col").alias("width"))


def _whole_heads(rows: DataFrame) -> DataFrame:
    """(sheet_id, head, first, last, width): the first rows of each sheet with all their cells, its first and last row and its last column.

    First rows are dealt to their sheet before they are gathered, as gathering them on the way there too would only sort
    them once more; a sheet has few of them. Of all others the map side leaves one line per sheet.
    """
    ends = F.min("row_idx").alias("first"), F.max("row_idx").alias("last"), F.max("last_col").alias("width")
    is_first = F.coalesce(F.col("row_idx") < SEARCHED_ROWS, F.lit(False))
    first = rows.where(is_first).select("sheet_id", F.col("row_idx").alias("first"), F.col("row_idx").alias("last"), F.col("last_col").alias("width"), _head("columns", "values").alias("row"))
    others = rows.where(~is_first).groupBy("sheet_id").agg(*ends)
    dealt = first.unionByName(others, allowMissingColumns=True).repartition("sheet_id")
    return dealt.groupBy("sheet_id").agg(F.collect_list("row").alias("head"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("width").alias("width"))


def header_rows(cells: DataFrame) -> DataFrame:
    """(sheet_id, header_row, score, is_subheader, data_from): the best header row of each sheet that has one."""
    return _best_rows(_heads(sheet_rows(cells))).where("header_row IS NOT NULL").drop("width", "line", "sub_line")


def _best_rows(heads: DataFrame, *more: str) -> DataFrame:
    """The header rows with the cells of the row (`line`) and of the sub-header below it (`sub_line`), null for a sheet without one.

    At most twelve rows per sheet, which stay in one row. A row that is not there is an empty row.
    """

    def found(head: Column, best: Column) -> Column:
        at = lambda step: F.get(F.filter(head, lambda r: r["row_idx"] == step - best["up"]), F.lit(0))
        return _let(F.struct(at(0).alias("own"), at(1).alias("sub"), at(2).alias("after")), lambda three: F.struct(
            three["own"]["row_idx"].alias("header_row"), best["score"].alias("score"), _has_subheader(three).alias("is_subheader"),
            _cells_of(three["own"]["columns"], three["own"]["values"]).alias("line"), _cells_of(three["sub"]["columns"], three["sub"]["values"]).alias("sub_line"),
        ))

    def best_of(head: Column) -> Column:
        scored = F.transform(head, lambda r: F.struct(_score(r).alias("score"), (-r["row_idx"]).alias("up")))
        best = F.array_max(F.filter(scored, lambda s: s["score"] > 0))
        return _let(best, lambda b: F.when(b.isNotNull(), found(head, b)))

    best = heads.select("sheet_id", "width", *more, F.when(F.col("last") >= LEAST_ROWS - 1, best_of(F.col("head"))).alias("best"))
    # An outer inline of one struct, filtered afterwards: Spark would else work it out again in a filter below.
    best = best.select("sheet_id", "width", *more, F.inline_outer(F.array("best")))
    return best.select(
        "sheet_id", *more, "header_row", "score", "is_subheader",
        (F.col("header_row") + F.when(F.col("is_subheader"), 2).otherwise(1)).alias("data_from"), "width", "line", F.when(F.col("is_subheader"), F.col("sub_line")).alias("sub_line"),
    )


def _has_subheader(three: Column) -> Column:
    own = three["own"]
    sub = {name: F.coalesce(three["sub"][name], F.lit(0)) for name in ("filled", "numeric")}
    after = {name: F.coalesce(three["after"][name], F.lit(0)) for name in ("filled", "numeric")}
    return (
        (sub["filled"] > 0)
        & (sub["numeric"] < sub["filled"] * SUBHEADER_NUMERIC)
        & ((own["filled"] < sub["filled"]) | (own["gaps"] > 0))
        & ((after["numeric"] > sub["numeric"]) | (after["filled"] == 0))
    )


def _text(cell: Column) -> Column:
    return F.coalesce(strip_spaces(cell["value"]), F.lit(""))


def _composed() -> Column:
    """Of a row of `_best_rows` the array of (col_idx, header), as long as the sheet is wide."""
    text = _text
    by_column = lambda cells: F.transform(cells, lambda cell: F.struct(cell["col_idx"].alias("col_idx"), text(cell).alias("text")))

    def last_of_each(cells: Column) -> Column:
        """Of several texts of a column the greatest, in the order of columns."""
        return _let(F.sort_array(cells), lambda c: F.filter(c, lambda x, i: (i == F.size(c) - 1) | ~x["col_idx"].eqNullSafe(F.get(c, i + 1)["col_idx"])))

    # A cell that is not in the table is an empty one: the header row reaches from column 0 to the sheet's last one.
    blanks = F.transform(F.sequence(F.lit(0), "width"), lambda i: F.struct(i.cast("int").alias("col_idx"), F.lit("").alias("text")))
    own = last_of_each(F.concat(blanks, by_column(F.col("line"))))
    below = F.coalesce(last_of_each(by_column(F.col("sub_line"))), F.filter(by_column(F.col("line")), lambda _: F.lit(False)))
    side = lambda cells, kind: F.transform(cells, lambda x: F.struct(x["col_idx"].alias("col_idx"), F.lit(kind).alias("kind"), x["text"].alias("text")))

    def with_sub(both: Column) -> Column:
        """The header's cells, each with the sub-header's cell of its column, which stands next to it."""

        def of(x: Column, i: Column) -> Column:
            nearest = F.get(both, i + 1)
            sub = F.when((nearest["kind"] == 1) & nearest["col_idx"].eqNullSafe(x["col_idx"]), nearest["text"])
            return F.struct(x["kind"].alias("kind"), x["col_idx"].alias("col_idx"), x["text"].alias("own"), F.coalesce(sub, F.lit("")).alias("sub"))

        return F.filter(F.transform(both, of), lambda x: x["kind"] == 0)

    def carried(cells: Column) -> Column:
        """The last filled cell up to each one."""
        add = lambda sofar, x: F.concat(sofar, F.array(F.when(x["own"] != "", x["own"]).otherwise(F.get(sofar, F.size(sofar) - 1))))
        return F.aggregate(cells, F.array().cast("array<string>"), add)

    def based(x: Column, last: Column) -> Column:
        sub = F.when((x["sub"] != "") & ~_numeric(x["sub"]), x["sub"])
        # The fixed part of the header; a running number is still missing where this is null.
        base = (
            F.when(x["own"] != "", F.when(sub.isNotNull() & (sub != x["own"]), F.concat_ws(" ", x["own"], sub)).otherwise(x["own"]))
            .when(sub.isNotNull(), F.concat_ws(" ", last, sub))
            .when(last.isNull(), F.concat(F.lit("Column "), (x["col_idx"] + 1).cast("string")))
        )
        # A running number counts the headers up to here that start with the last filled
        # one; adding a number to a header does not change what it starts with.
        return _let(base, lambda b: F.struct(x["col_idx"].alias("col_idx"), b.alias("base"), last.alias("last"), F.coalesce(b, F.concat(last, F.lit(" "))).alias("start")))

    def finished(row: Column) -> Column:
        def finish(h: Column, i: Column) -> Column:
            number = F.size(F.filter(F.slice(row["start"], F.lit(1), i + 1), lambda s: s.startswith(h["last"])))
            return F.struct(h["col_idx"].alias("col_idx"), F.coalesce(h["base"], F.concat_ws(" ", h["last"], number.cast("string"))).alias("header"))

        return F.transform(row, finish)

    def composed(cells: Column) -> Column:
        based_on = _let(carried(cells), lambda last: F.transform(cells, lambda x, i: based(x, F.get(last, i))))
        return _let(based_on, finished)

    return _let(F.sort_array(F.concat(side(own, 0), side(below, 1))), lambda both: _let(with_sub(both), composed))


def sheet_headers(cells: DataFrame) -> DataFrame:
    """(sheet_id, data_from, col_idx, header, name): composed header per column, and its name after repeats got a suffix.

    An empty header cell takes the last filled one to its left, together with
    its own sub-header, or else with a running number.
    """
    best = _best_rows(_heads(sheet_rows(cells))).where("header_row IS NOT NULL")
    # An outer inline, filtered afterwards: for an inner one Spark would compose the row again in a filter below it.
    headers = best.select("sheet_id", "data_from", _composed().alias("row")).select("sheet_id", "data_from", F.inline_outer("row")).where("header IS NOT NULL")
    repeat = F.row_number().over(Window.partitionBy("sheet_id", "header").orderBy("col_idx")) - 1
    return headers.withColumn("name", F.when(repeat > 0, F.concat_ws("_", "header", repeat.cast("string"))).otherwise(F.col("header")))


def _named(row: Column) -> Column:
    """(col_idx, header, name) of a row of (col_idx, header) in the order of columns: a header that comes again gets a suffix."""
    by_header = F.sort_array(F.transform(row, lambda x, i: F.struct(x["header"].alias("header"), i.alias("place"), x["col_idx"].alias("col_idx"))))

    def named(sides: Column) -> Column:
        def name(x: Column, i: Column) -> Column:
            # Equal headers stand side by side; only one that repeats looks for the first of them.
            again = F.get(sides, i - 1)["header"] == x["header"]
            suffixed = F.concat_ws("_", x["header"], (i + 1 - F.array_position(sides["header"], x["header"])).cast("string"))
            return F.struct(x["col_idx"].alias("col_idx"), x["header"].alias("header"), F.when(again, suffixed).otherwise(x["header"]).alias("name"))

        return F.sort_array(F.transform(sides, name))

    return _let(by_header, named)


def _garbage(header: Column) -> Column:
    name = strip_spaces(header)
    number = _numeric(name) & ~_year(name)
    short = (F.length(name) <= GARBAGE_LENGTH) & name.rlike(r"[/\\]")
    decimal = name.rlike(r"^\d+\.\d+$")
    return number | short | decimal


def _rejected(columns: Column, garbage: Column) -> Column:
    return (columns >= GARBAGE_COLUMNS) & (garbage > columns * GARBAGE_SHARE)


def header_quality(headers: DataFrame) -> DataFrame:
    """(sheet_id, columns, garbage, rejected): sheets whose headers look like data."""
    counted = headers.groupBy("sheet_id").agg(F.count("*").alias("columns"), F.count_if(_garbage(F.col("header"))).alias("garbage"))
    return counted.withColumn("rejected", _rejected(F.col("columns"), F.col("garbage")))


def _first_row(line: Column, width: Column) -> Column:
    """(col_idx, header) of the cells of a first row, from column 0 to the sheet's last; a column whose cell comes twice is there twice."""
    side = lambda col, kind, text: F.struct(col.cast("int").alias("col_idx"), F.lit(kind).alias("kind"), text.alias("text"))
    columns = F.transform(F.sequence(F.lit(0), width), lambda i: side(i, 0, F.lit("")))
    held = F.filter(line, lambda c: c["col_idx"].between(F.least(F.lit(0), width), F.greatest(F.lit(0), width)))
    cells = F.coalesce(F.transform(held, lambda c: side(c["col_idx"], 1, _text(c))), F.filter(columns, lambda _: F.lit(False)))

    def with_cells(both: Column) -> Column:
        """The cells, and the columns that no cell follows."""
        following = lambda x, i: F.coalesce((F.get(both, i + 1)["kind"] == 1) & (F.get(both, i + 1)["col_idx"] == x["col_idx"]), F.lit(False))
        return F.filter(both, lambda x, i: (x["kind"] == 1) | ~following(x, i))

    header = lambda x: F.when(x["text"] != "", x["text"]).otherwise(F.concat(F.lit("Column "), (x["col_idx"] + 1).cast("string")))
    row = _let(F.sort_array(F.concat(columns, cells)), with_cells)
    return F.transform(row, lambda x: F.struct(x["col_idx"].alias("col_idx"), header(x).alias("header")))


def _first_rows(rows: DataFrame) -> DataFrame:
    """(sheet_id, data_from, names) by the first row of each sheet."""
    first = F.min_by(F.struct("columns", "values"), "row_idx").alias("cells")
    found = rows.groupBy("sheet_id").agg(F.min("row_idx").alias("first"), F.max("last_col").alias("width"), first)
    line = F.when(F.col("sheet_id").isNotNull(), _cells_of("cells.columns", "cells.values"))
    return found.select("sheet_id", (F.col("first") + 1).alias("data_from"), _named(_first_row(line, F.col("width"))).alias("names"))


def first_row_headers(cells: DataFrame) -> DataFrame:
    """(sheet_id, data_from, col_idx, header, name): the first row of each sheet as its header, for want of a better one.

    The header reaches to the sheet's last column, however short its first row is.
    """
    return _by_column(_first_rows(sheet_rows(cells)))


def _by_column(sheets: DataFrame) -> DataFrame:
    return sheets.select("sheet_id", "data_from", F.inline_outer("names")).where("header IS NOT NULL")


def accepted_headers(cells: DataFrame) -> DataFrame:
    """The headers of every sheet: the best header row where it reads like one, else the first row."""
    rows = kept(sheet_rows(cells), "rows")
    return _by_column(_with_late(rows, kept(_sheets(rows, fallback=True), "rows-by-sheet")))


def _sheets(rows: DataFrame, fallback: bool) -> DataFrame:
    """(sheet_id, data_from, names, long, late, head): one row per sheet, with the names of its columns and those of its first rows that are data.

    The first rows travel to their sheet once, whole, and find their names there. With `fallback` a sheet whose header is rejected
    or missing is named by its first row; `late` are those where that row is not among the first ones. `long` sheets have more rows.
    """
    best = _best_rows(_whole_heads(rows), "head", "first", "last")
    found = _named(F.filter(_composed(), lambda x: x["header"].isNotNull()))
    by_header = lambda names: F.struct(F.col("data_from").alias("data_from"), names.alias("names"))
    chosen = by_header(found)
    below = F.coalesce(F.col("first") >= SEARCHED_ROWS, F.lit(False))
    if fallback:
        first = F.get(F.filter("head", lambda r: r["row_idx"] == F.col("first")), F.lit(0))
        line = F.when(F.col("sheet_id").isNotNull(), _let(first, lambda r: _cells_of(r["columns"], r["values"])))
        plain = F.when(~below, _named(_first_row(line, F.col("width"))))
        readable = lambda names: F.col("sheet_id").isNotNull() & (F.size(names) > 0) & ~_rejected(F.size(names), F.size(F.filter(names, lambda n: _garbage(n["header"]))))
        chosen = _let(found, lambda names: F.when(readable(names), by_header(names)).otherwise(F.struct((F.col("first") + 1).alias("data_from"), plain.alias("names"))))
    # An outer inline of one struct here too, so that names are made once.
    named = best.select("sheet_id", "head", "first", "last", F.inline_outer(F.array(chosen)))
    data = F.filter("head", lambda r: (r["filled"] >= LEAST_CELLS) & (r["row_idx"] >= F.col("data_from")))
    data = F.transform(data, lambda r: F.struct(r["row_idx"].alias("row_idx"), r["columns"].alias("columns"), r["values"].alias("values")))
    long = F.coalesce(F.col("last") >= SEARCHED_ROWS, F.lit(False))
    return named.select("sheet_id", "data_from", "names", long.alias("long"), (F.col("names").isNull() & below).alias("late"), data.alias("head"))


def _with_late(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    """The sheets, late ones with the names by their first row, which is looked for among the rows only if there are such sheets."""
    late = sheets.where("late")
    if late.isEmpty():
        return sheets
    firsts = _first_rows(rows.join(late.select("sheet_id"), "sheet_id", "left_semi"))
    return sheets.where("NOT late").unionByName(firsts.withColumn("long", F.lit(True)), allowMissingColumns=True)


def grid_cells(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, col_idx, name, value, number): the data cells of every sheet under their headers.

    Data rows start below the header and have two or more filled cells. Rows are gathered and judged by (sheet, row), a key
    that no large sheet makes hot, and kept. A sheet's first rows meet its names in the sheet's own row; only rows further
    down meet them in a join, whose large partitions Spark splits.
    """
    rows = kept(sheet_rows(cells), "rows")
    return _under(rows, kept(_sheets(rows, fallback=False), "rows-by-sheet"))


def _under(rows: DataFrame, sheets: DataFrame) -> DataFrame:
    names = F.transform(F.filter("names", lambda n: n["col_idx"].isNotNull()), lambda n: F.struct(n["col_idx"].alias("col_idx"), n["name"].alias("name")))
    sheets = sheets.where("sheet_id IS NOT NULL AND names IS NOT NULL").withColumn("names", names)
    further = rows.where((F.col("filled") >= LEAST_CELLS) & (F.col("row_idx") >= SEARCHED_ROWS)).select("sheet_id", "row_idx", "columns", "values")
    further = further.join(sheets.where("long").select("sheet_id", "data_from", "names"), "sheet_id").where(F.col("row_idx") >= F.col("data_from"))
    data = sheets.select("sheet_id", "names", F.inline("head")).unionByName(further.drop("data_from"))
    # Mostly columns follow each other, so a name's place is known; where some are missing or come twice, names are searched.
    at = F.col("names")["col_idx"]
    data = data.withColumn("least", F.get(at, F.lit(0))).withColumn("in_line", (F.get(at, F.size("names") - 1) - F.col("least") + 1 == F.size("names")) & (F.size(F.array_distinct(at)) == F.size("names")))
    near = lambda c: F.filter(F.array(F.get("names", (c - F.col("least")).cast("int"))), lambda n: n.isNotNull())
    names_of = lambda c: F.when(F.col("in_line"), near(c)).otherwise(F.filter("names", lambda n: n["col_idx"] == c))
    named = lambda c, v: F.transform(names_of(c), lambda n: F.struct(c.alias("col_idx"), n["name"].alias("name"), v.alias("value")))
    held = F.flatten(F.zip_with("columns", "values", named))
    data = data.select("sheet_id", "row_idx", F.inline_outer(held)).where("name IS NOT NULL")
    return data.select("sheet_id", "row_idx", "col_idx", "name", "value", js_number(F.col("value")).alias("number"))


def grid_table(cells: DataFrame) -> DataFrame:
    """(sheet_id, row_idx, col_idx, name, value, number): every sheet as a normalized table, from raw cells to the end.

    Sheets whose header row is rejected, or that have none, are read below their first row. Text is trimmed, blank cells
    are null, and rows with fewer than two filled cells are left out.
    """
    text = strip_spaces(F.col("value"))
    rows = kept(sheet_rows(cells), "rows")
    sheets = _with_late(rows, kept(_sheets(rows, fallback=True), "rows-by-sheet"))
    return _under(rows, sheets).withColumn("value", F.when(text != "", text))
