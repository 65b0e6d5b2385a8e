"""Text tables, cell grids and parsed-table normalization over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import grids, normalize, sinks, tables, text_tables
from . import sql_text as q
from .registry import register, view
from .views import read

MEMOS = ("order_memos",)
GRID = ("cell_grid",)
SPACE3, SPACE2 = q.SPACES + "{3,}", q.SPACES + "{2,}"
STYLES = (("tab", r"\t", 0.4, 5, False, 2), ("comma", ",", 0.4, 5, False, 2), ("pipe", r"\|", 0.4, 5, False, 2), ("spaces", SPACE3, 0.3, 8, True, 2), ("double_space", SPACE2, 0, 0, True, 3))


def _trimmed(x: str) -> str:
    return q.strip(x)


def _lines_sql(source: str) -> str:
    return f"lines AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trimmed('x')}), lambda x: x <> '') AS lines FROM {source})"


def _style_sql(style: tuple) -> str:
    """Per document: where a style's header is and whether the style applies."""
    name, pattern, least, within, letter, least_lines = style
    filled = f"len(list_filter(regexp_split_to_array(x, '{pattern}'), lambda p: {_trimmed('p')} <> ''))"
    fits = f"{filled} >= 2" + (" AND regexp_matches(x, '[a-zA-Z]')" if letter else "")
    searched = f"lines[1:{within}]" if within else "lines"
    return f"""{name}_s AS (SELECT doc_id, lines, head_at FROM (
      SELECT doc_id, lines, list_position(list_transform({searched}, lambda x: {fits}), true) AS head_at FROM lines)
    WHERE head_at > 0 AND len(lines) >= {least_lines} AND len(list_filter(lines, lambda x: regexp_matches(x, '{pattern}'))) >= {least} * len(lines)
      AND len(list_filter(lines[head_at + 1:], lambda x: {filled} >= 2)) > 0)"""


def _detected_sql(source: str) -> str:
    found = q.union([f"SELECT doc_id, {i} AS place, '{s[0]}' AS separator, '{s[1]}' AS pattern, head_at FROM {s[0]}_s" for i, s in enumerate(STYLES)])
    styles = ", ".join(_style_sql(s) for s in STYLES)
    return f"""{_lines_sql(source)}, {styles}, best AS (SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) = 1),
  tabs AS (SELECT doc_id, separator, head_at, {_split_by_style('lines[head_at]')} AS headers, list_filter(list_transform(lines[head_at + 1:], lambda x: {_split_by_style('x', keep_empty=True)}),
      lambda r: len(list_filter(r, lambda p: p <> '')) >= 2) AS body FROM best JOIN lines USING (doc_id))"""


def _split_by_style(x: str, keep_empty: bool = False) -> str:
    def one(pattern: str) -> str:
        parts = f"list_transform(regexp_split_to_array({x}, '{pattern}'), lambda p: {_trimmed('p')})"
        return parts if keep_empty else f"list_filter({parts}, lambda p: p <> '')"

    return "CASE separator " + " ".join(f"WHEN '{s[0]}' THEN {one(s[1])}" for s in STYLES) + " END"


def _shapes_sql(source: str) -> str:
    return f"""WITH {_detected_sql(source)}
SELECT lines.doc_id, CAST(len(lines) AS INTEGER) AS line_count, separator, head_at - 1 AS header_line, array_to_string(headers, ' / ') AS headers, CAST(len(body) AS INTEGER) AS row_count
FROM lines LEFT JOIN tabs ON tabs.doc_id = lines.doc_id"""


def _cells_sql(source: str) -> str:
    return f"""WITH {_detected_sql(source)}, r AS (SELECT doc_id, headers, unnest(body) AS cells, generate_subscripts(body, 1) - 1 AS row FROM tabs),
  c AS (SELECT doc_id, row, unnest(headers) AS header, generate_subscripts(headers, 1) - 1 AS col, cells FROM r)
SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, header, NULLIF(cells[col + 1], '') AS value,
  {q.number("replace(NULLIF(cells[col + 1], ''), ',', '')")} AS number FROM c"""


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@register("text_table_detect", MEMOS, _shapes_sql("order_memos"))
def text_table_detect(spark, sf_dir):
    return text_tables.table_shapes(text_tables.detect_tables(view(spark, sf_dir, "order_memos")))


@register("text_table_cells", MEMOS, _cells_sql("order_memos"))
def text_table_cells(spark, sf_dir):
    return text_tables.table_cells(text_tables.detect_tables(view(spark, sf_dir, "order_memos")))


@register("document_table_detect", (), _shapes_sql("documents"))
def document_table_detect(spark, sf_dir):
    return text_tables.table_shapes(text_tables.detect_tables(documents(spark, sf_dir)))


@register("document_table_cells", (), _cells_sql("documents"))
def document_table_cells(spark, sf_dir):
    return text_tables.table_cells(text_tables.detect_tables(documents(spark, sf_dir)))


_TEXT = "(value IS NOT NULL AND trim(value) <> '')"
_NUM = q.number("value")
FACTS_SQL = f"""facts AS MATERIALIZED (SELECT sheet_id, row_idx, COUNT(*) FILTER (WHERE {_TEXT}) AS filled, COUNT({_NUM}) AS nums,
    COUNT(*) FILTER (WHERE {_NUM} = FLOOR({_NUM}) AND {_NUM} BETWEEN 1900 AND 2099) AS years, COUNT(*) FILTER (WHERE value IS NULL OR value = '') AS gaps
  FROM cell_grid GROUP BY 1, 2),
scored AS (SELECT f.*, filled - nums AS texts, nums - years AS plain, (filled - nums + years) * 2 + filled + CASE WHEN row_idx BETWEEN 1 AND 3 THEN 3 ELSE 0 END AS score FROM facts f),
long_sheets AS MATERIALIZED (SELECT sheet_id FROM cell_grid GROUP BY 1 HAVING MAX(row_idx) >= 2),
best AS MATERIALIZED (SELECT * FROM scored WHERE row_idx < 10 AND filled >= 2 AND NOT (plain > 2 AND texts > 0 AND plain >= texts)
  AND sheet_id IN (SELECT sheet_id FROM long_sheets) QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY score DESC, row_idx) = 1),
found AS MATERIALIZED (SELECT b.sheet_id, b.row_idx AS header_row, b.score,
    COALESCE(s.filled > 0 AND s.nums < s.filled * 0.5 AND (b.filled < s.filled OR b.gaps > 0) AND (COALESCE(n.nums, 0) > s.nums OR COALESCE(n.filled, 0) = 0), FALSE) AS is_subheader
  FROM best b LEFT JOIN facts s ON s.sheet_id = b.sheet_id AND s.row_idx = b.row_idx + 1 LEFT JOIN facts n ON n.sheet_id = b.sheet_id AND n.row_idx = b.row_idx + 2)"""


@register("grid_header_row", GRID, f"WITH {FACTS_SQL} SELECT *, header_row + CASE WHEN is_subheader THEN 2 ELSE 1 END AS data_from FROM found")
def grid_header_row(spark, sf_dir):
    return grids.header_rows(view(spark, sf_dir, "cell_grid"))


HEADERS_SQL = FACTS_SQL + """, own AS (SELECT f.sheet_id, c.col_idx, COALESCE(trim(c.value), '') AS own, CASE WHEN is_subheader THEN COALESCE(trim(s.value), '') ELSE '' END AS sub
  FROM found f JOIN cell_grid c ON c.sheet_id = f.sheet_id AND c.row_idx = f.header_row LEFT JOIN cell_grid s ON s.sheet_id = f.sheet_id AND s.row_idx = f.header_row + 1 AND s.col_idx = c.col_idx),
carried AS (SELECT *, last_value(NULLIF(own, '') IGNORE NULLS) OVER (PARTITION BY sheet_id ORDER BY col_idx ROWS UNBOUNDED PRECEDING) AS last FROM own),
numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet_id, last ORDER BY col_idx) AS i, TRY_CAST(sub AS DOUBLE) IS NOT NULL AS sub_number FROM carried),
headers AS (SELECT sheet_id, col_idx, CASE
    WHEN own <> '' AND sub <> '' AND sub <> own AND NOT sub_number THEN own || ' ' || sub WHEN own <> '' THEN own
    WHEN sub <> '' AND NOT sub_number THEN concat_ws(' ', last, sub) WHEN last IS NOT NULL THEN last || ' ' || i ELSE 'Column ' || (col_idx + 1) END AS header FROM numbered)"""


@register("grid_header_fill", GRID, f"WITH {HEADERS_SQL} SELECT * FROM headers")
def grid_header_fill(spark, sf_dir):
    return grids.sheet_headers(view(spark, sf_dir, "cell_grid")).select("sheet_id", "col_idx", "header")


NAMED_SQL = HEADERS_SQL + """, named AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sheet_id, header ORDER BY col_idx) > 1
    THEN header || '_' || (row_number() OVER (PARTITION BY sheet_id, header ORDER BY col_idx) - 1) ELSE header END AS name FROM headers)"""


@register("header_dedup", GRID, f"WITH {NAMED_SQL} SELECT * FROM named")
def header_dedup(spark, sf_dir):
    return grids.sheet_headers(view(spark, sf_dir, "cell_grid")).drop("data_from")


@register("grid_cells", GRID, f"""WITH {NAMED_SQL}
SELECT c.sheet_id, c.row_idx, c.col_idx, n.name, c.value, {q.number('c.value')} AS number FROM cell_grid c
JOIN found f ON f.sheet_id = c.sheet_id AND c.row_idx >= f.header_row + CASE WHEN is_subheader THEN 2 ELSE 1 END
JOIN facts r ON r.sheet_id = c.sheet_id AND r.row_idx = c.row_idx AND r.filled >= 2 JOIN named n ON n.sheet_id = c.sheet_id AND n.col_idx = c.col_idx""")
def grid_cells(spark, sf_dir):
    return grids.grid_cells(view(spark, sf_dir, "cell_grid"))


@register("header_garbage", GRID, """
WITH rows AS (SELECT sheet_id, row_idx, COALESCE(value, '') AS h, col_idx FROM cell_grid)
SELECT sheet_id, row_idx, COUNT(*) AS columns, COUNT(*) FILTER (WHERE bad) AS garbage, COUNT(*) >= 3 AND COUNT(*) FILTER (WHERE bad) > COUNT(*) * 0.4 AS rejected FROM (
  SELECT sheet_id, row_idx, (TRY_CAST(h AS DOUBLE) IS NOT NULL AND NOT (TRY_CAST(h AS DOUBLE) = FLOOR(TRY_CAST(h AS DOUBLE)) AND TRY_CAST(h AS DOUBLE) BETWEEN 1900 AND 2099))
    OR (LENGTH(h) <= 2 AND regexp_matches(h, '[/\\\\]')) OR regexp_matches(h, '^\\d+\\.\\d+$') AS bad FROM rows)
GROUP BY 1, 2""")
def header_garbage(spark, sf_dir):
    """Every row of every sheet judged as if it were the header."""
    cells = view(spark, sf_dir, "cell_grid")
    rows = cells.select(F.struct("sheet_id", "row_idx").alias("sheet_id"), F.coalesce("value", F.lit("")).alias("header"))
    return grids.header_quality(rows).select("sheet_id.sheet_id", "sheet_id.row_idx", "columns", "garbage", "rejected")


@register("norm_min_two_nonnull", ("sparse_orders",), """
WITH t AS (SELECT _ord, NULLIF(trim(priority), '') AS priority, NULLIF(trim("__EMPTY"), '') AS "__EMPTY", NULLIF(trim("__EMPTY_1"), '') AS "__EMPTY_1",
    NULLIF(trim("EMPTY 2"), '') AS "EMPTY 2", NULLIF(trim(customer), '') AS customer FROM sparse_orders)
SELECT _ord, priority, "__EMPTY" AS years, "__EMPTY_1" AS "Category", "EMPTY 2" AS "Category Amount", customer FROM t
WHERE (priority IS NOT NULL)::INT + ("__EMPTY" IS NOT NULL)::INT + ("__EMPTY_1" IS NOT NULL)::INT + ("EMPTY 2" IS NOT NULL)::INT + (customer IS NOT NULL)::INT >= 2""")
def norm_min_two_nonnull(spark, sf_dir):
    out = normalize.normalize_parsed(view(spark, sf_dir, "sparse_orders"), ["_ord"])
    # The year column's name holds its first value; SQL cannot name a column after data.
    year = next(c for c in out.columns if c.startswith("Year_"))
    return out.withColumnRenamed(year, "years")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_MEMO_COLUMNS = ["doc_id", "text"]


@register("src_json_lines", ("order_memos",), "SELECT doc_id, text FROM order_memos")
def src_json_lines(spark, sf_dir):
    """Every memo written as JSON lines and read back."""
    path = _folder(spark)
    sinks.write_report(view(spark, sf_dir, "order_memos").select(*_MEMO_COLUMNS), path)
    return tables.read_table(spark, path, "ndjson", schema="doc_id bigint, text string")


@register("sink_parquet", ("order_memos",), "SELECT doc_id, text FROM order_memos")
def sink_parquet(spark, sf_dir):
    path = _folder(spark)
    sinks.write_parquet(view(spark, sf_dir, "order_memos").select(*_MEMO_COLUMNS), path)
    return tables.read_table(spark, path, "parquet")


FILES = 8


def _written_lines(key: Column, lines: DataFrame, first: str, last: str | None = None) -> str:
    """A folder of text files, each with a first (and a last) line of its own around the lines dealt to it. `lines` has `line` and `place`."""
    spark = lines.sparkSession
    path = _folder(spark)
    ends = spark.range(FILES).select(F.col("id").cast("int").alias("file"), F.inline(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(x).alias("line")) for p, x in ((-1, first), (9, last)) if x is not None))))
    dealt = lines.select(F.pmod(F.xxhash64(key), F.lit(FILES)).cast("int").alias("file"), "place", "line")
    dealt.unionByName(ends).repartition("file").sortWithinPartitions("file", "place").select("file", "line").write.partitionBy("file").text(path)
    return f"{path}/file=*"


@register("src_csv_normalized", (), """
SELECT CAST(o_orderkey AS VARCHAR) AS "order", o_orderpriority AS priority, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
  'say "hi", ' || o_orderstatus || chr(10) || 'end' AS price_1, CAST(o_custkey AS VARCHAR) AS "price_1 Amount", 'status ' || o_orderstatus AS "Category" FROM orders""")
def src_csv_normalized(spark, sf_dir):
    """Orders as CSV files and read back: padded and quoted cells with quotes, commas and line breaks, a repeated header, unnamed columns, rows of one cell."""
    orders = read(spark, sf_dir, "orders")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    note = F.concat(F.lit('say "hi", '), F.col("o_orderstatus"), F.lit("\nend"))
    cells = [
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")), quoted(F.concat(F.col("o_orderpriority"), F.lit("  "))), F.floor("o_totalprice").cast("bigint").cast("string"),
        quoted(note), F.col("o_custkey").cast("string"), F.concat(F.lit("status "), F.col("o_orderstatus")), F.lit(" "),
    ]
    full = orders.select("o_orderkey", F.lit(0).alias("place"), F.concat_ws(",", *cells).alias("line"))
    sparse = orders.select("o_orderkey", F.lit(0).alias("place"), F.concat(F.col("o_orderkey").cast("string"), F.lit(",,,,,,")).alias("line"))
    path = _written_lines(F.col("o_orderkey"), full.unionByName(sparse), 'order,priority,price,"price",__EMPTY,__EMPTY_1,__EMPTY_2')
    return tables.read_table(spark, path, "csv")


_ORDER_JSON = "SELECT o_orderkey AS key, o_orderpriority AS priority, o_totalprice AS price FROM orders"


def _json_lines(orders: DataFrame) -> DataFrame:
    """One object a line, all but the first of a file after a comma."""
    rows = orders.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    file = F.pmod(F.xxhash64("key"), F.lit(FILES))
    firsts = rows.groupBy(file.alias("file")).agg(F.min("key").alias("first"))
    first = F.col("first") == F.col("key")
    line = F.to_json(F.struct("key", "priority", "price"))
    return rows.join(firsts, file == F.col("file")).select(F.col("key").alias("o_orderkey"), F.when(first, 0).otherwise(1).alias("place"), F.when(first, line).otherwise(F.concat(F.lit(","), line)).alias("line"))


_JSON_SCHEMA = "key bigint, priority string, price double"


@register("src_json_array", (), _ORDER_JSON)
def src_json_array(spark, sf_dir):
    """Orders as files of one JSON array each, read back."""
    path = _written_lines(F.col("o_orderkey"), _json_lines(read(spark, sf_dir, "orders")), "[", "]")
    return tables.read_table(spark, path, "json", schema=_JSON_SCHEMA)


@register("src_json_wrapped", (), _ORDER_JSON)
def src_json_wrapped(spark, sf_dir):
    """Orders as files of one object each that wraps them, read back."""
    path = _written_lines(F.col("o_orderkey"), _json_lines(read(spark, sf_dir, "orders")), '{"source": "orders", "note": [], "items": [', "]}")
    return tables.read_table(spark, path, "json", table_field="items").select("key", "priority", "price")


@register("sink_drilldown", ("projects_raw",), """
SELECT regexp_replace(regexp_replace(lower(trim(region)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, trim(region) AS region, province, COUNT(*) AS projects,
  CAST(SUM(CAST(contract_cost AS DECIMAL(18,2))) AS DOUBLE) AS total_cost
FROM projects_raw WHERE region IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2, 3""")
def sink_drilldown(spark, sf_dir):
    """Totals by region and province, a folder of files per region, read back."""
    rows = view(spark, sf_dir, "projects_raw").where("region IS NOT NULL AND province IS NOT NULL")
    totals = rows.groupBy(F.trim("region").alias("region"), "province").agg(F.count("*").alias("projects"), F.sum(F.col("contract_cost").cast("decimal(18,2)")).cast("double").alias("total_cost"))
    path = _folder(spark)
    sinks.write_drilldown(totals, "region", path)
    return spark.read.schema("region string, province string, projects bigint, total_cost double, slug string").json(path)


@register("grid_table", GRID, f"""WITH {NAMED_SQL}
SELECT c.sheet_id, c.row_idx, c.col_idx, n.name, NULLIF(trim(c.value), '') AS value, {q.number('c.value')} AS number FROM cell_grid c
JOIN found f ON f.sheet_id = c.sheet_id AND c.row_idx >= f.header_row + CASE WHEN is_subheader THEN 2 ELSE 1 END
JOIN facts r ON r.sheet_id = c.sheet_id AND r.row_idx = c.row_idx AND r.filled >= 2 JOIN named n ON n.sheet_id = c.sheet_id AND n.col_idx = c.col_idx
WHERE c.sheet_id % 4 <> 3 AND c.value IS NOT NULL
UNION ALL SELECT c.sheet_id, c.row_idx, c.col_idx, CASE c.col_idx WHEN 0 THEN 'Order ' || c.sheet_id ELSE 'Column ' || (c.col_idx + 1) END, v, {q.number('v')}
FROM (SELECT *, NULLIF(trim(CASE WHEN col_idx = 0 THEN replace(value, 'Line ', '') ELSE value END), '') AS v FROM cell_grid) c
JOIN facts r ON r.sheet_id = c.sheet_id AND r.row_idx = c.row_idx AND r.filled >= 2
WHERE c.sheet_id % 4 = 3 AND c.row_idx > 2 AND c.value IS NOT NULL""")
def grid_table(spark, sf_dir):
    """Grids without their empty cells. Every fourth sheet has a title and then numbers only, so its header is rejected and it is read whole below its first row."""
    cells = view(spark, sf_dir, "cell_grid").where("value IS NOT NULL")
    plain = cells.where("sheet_id % 4 <> 3")
    numbers = F.when((F.col("col_idx") == 0) & (F.col("row_idx") > 2), F.replace("value", F.lit("Line "), F.lit(""))).otherwise(F.col("value"))
    odd = cells.where("sheet_id % 4 = 3 AND row_idx NOT IN (1, 2)").withColumn("value", numbers)
    return grids.grid_table(plain.unionByName(odd))
