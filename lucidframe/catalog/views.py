"""Input views derived from the given tables.

Each view is one SQL text that Spark and the checking engine both run, so a
check differs from the query only in the operator under test. The given tables
hold no nulls, blanks or mixed spellings; the CASE expressions put them in by
key arithmetic. Every view keeps every row of its source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Raw project records: nulls, zero costs, padded names, an invalid date, repeated keys.
PROJECTS_RAW = """
SELECT
  CAST(year(o.o_orderdate) AS INT) AS infra_year,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE '  ' || r.r_name || ' ' END AS region,
  CASE WHEN l.l_partkey % 89 = 0 THEN NULL ELSE n.n_name END AS province,
  c.c_mktsegment AS municipality,
  o.o_orderpriority AS implementing_office,
  CASE WHEN l.l_orderkey % 101 = 0 THEN NULL ELSE 'P' || CAST(l.l_orderkey AS STRING) END AS project_id,
  p.p_name AS project_description,
  l.l_returnflag AS program,
  CASE WHEN l.l_partkey % 31 = 0 THEN NULL ELSE p.p_type END AS type_of_work,
  p.p_brand AS infra_type,
  CAST(n.n_nationkey AS DOUBLE) AS longitude,
  CAST(r.r_regionkey AS DOUBLE) AS latitude,
  'C' || CAST(l.l_linenumber AS STRING) AS contract_id,
  CASE WHEN l.l_partkey % 71 = 0 THEN NULL ELSE l.l_extendedprice END AS abc,
  CASE WHEN l.l_suppkey % 41 = 0 THEN CAST(0 AS DOUBLE)
       ELSE CAST(CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS DOUBLE)
  END AS contract_cost,
  CASE WHEN l.l_partkey % 19 = 0 THEN NULL
       ELSE CAST(788918400000 AS BIGINT) + (l.l_orderkey % 2400) * 86400000 END AS completion_date_original,
  CAST(year(l.l_shipdate) AS INT) AS completion_year,
  CASE WHEN l.l_suppkey % 23 = 0 THEN NULL ELSE s.s_name END AS contractor,
  CASE WHEN l.l_partkey % 43 = 0 THEN NULL ELSE CAST(CAST(year(o.o_orderdate) AS INT) AS STRING) END AS funding_year,
  'L' || CAST(l.l_suppkey % 9 AS STRING) AS legislative_district,
  'E' || CAST(n.n_nationkey AS STRING) AS district_engineering_office,
  CASE WHEN l.l_partkey % 53 = 0 THEN '2021-02-30' WHEN l.l_suppkey % 17 = 0 THEN NULL
       ELSE CAST(CAST(l.l_shipdate AS DATE) AS STRING) END AS completion_date_actual,
  CASE WHEN l.l_partkey % 37 = 0 THEN '' ELSE CAST(CAST(o.o_orderdate AS DATE) AS STRING) END AS start_date,
  l.l_orderkey AS _order, l.l_partkey AS _part, l.l_suppkey AS _supp
FROM {lineitem} l
JOIN {orders} o ON l.l_orderkey = o.o_orderkey
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {part} p ON l.l_partkey = p.p_partkey
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Wide table: one row per supplier, seven period columns of ten.
_YEARS = range(1995, 2002)


def _year_column(year: int) -> str:
    extra = {1995: " AND n.n_nationkey % 5 <> 0", 1996: " AND n.n_nationkey % 7 <> 0"}.get(year, "")
    missing = " ELSE 0" if year == 1995 else ""
    return (
        f"  CAST(SUM(CASE WHEN year(l.l_shipdate) = {year}{extra} "
        f"THEN CAST(l.l_extendedprice AS DECIMAL(18,2)){missing} END) AS DECIMAL(18,2)) AS <q>{year}<q>"
    )


SUPPLIER_YEARS = (
    "SELECT r.r_name AS region, n.n_name AS nation, s.s_name AS supplier,\n"
    + ",\n".join(_year_column(y) for y in _YEARS)
    + """
FROM {lineitem} l
JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} n ON s.s_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
GROUP BY r.r_name, n.n_name, s.s_name
"""
)

# Contact records, one per order: mixed spellings, money and percent strings, blanks,
# outliers. Customers with several orders repeat, which makes exact duplicates.
DIRTY_CUSTOMERS = """
SELECT c.c_custkey,
  CASE o.o_orderkey % 3 WHEN 0 THEN upper(c.c_mktsegment) WHEN 1 THEN lower(c.c_mktsegment)
       ELSE '  ' || c.c_mktsegment || ' ' END AS segment,
  CASE WHEN c.c_custkey % 29 = 0 THEN '(1,000)'
       ELSE '$' || CAST(1 + c.c_custkey % 90 AS STRING) || ',' || lpad(CAST(c.c_custkey * 7 % 1000 AS STRING), 3, '0') || '.50' END AS balance_text,
  CASE WHEN c.c_custkey % 31 = 0 THEN 'n/a%' ELSE CAST(c.c_custkey % 40 AS STRING) || '%' END AS rate_text,
  CASE WHEN c.c_custkey % 11 = 0 THEN '' WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_name || '   ok ' END AS note,
  CAST(CASE WHEN c.c_custkey % 100 = 0 THEN 1000000.0 + c.c_custkey ELSE c.c_acctbal END AS DECIMAL(18,2)) AS balance
FROM {customer} c
JOIN {orders} o ON c.c_custkey = o.o_custkey
"""

# Two standard long tables.
EVENT_FACTS = """
SELECT event_id, CAST(ts AS DATE) AS event_day, event_type, CAST(value AS DECIMAL(18,2)) AS value, user_id
FROM {events}
"""

LINE_FACTS = """
SELECT l_orderkey AS order_no, CAST(l_shipdate AS DATE) AS ship_date, l_returnflag AS return_flag,
  l_linestatus AS line_status, CAST(l_quantity AS DECIMAL(18,2)) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS discount,
  CAST(l_tax AS DECIMAL(18,2)) AS tax,
  l_partkey AS _part, l_suppkey AS _supp
FROM {lineitem}
"""

# Short documents with a small table, one per order, in six styles; the last is plain prose.
ORDER_MEMOS = """
SELECT doc_id, 'Memo of order ' || CAST(doc_id AS STRING) || chr(10) || '   ' || chr(10) ||
  CASE WHEN d IS NULL THEN 'Nothing to report, all is well' || chr(10) || 'Status ' || o_orderstatus
  ELSE 'field' || d || 'value' || d || d || 'note' || chr(10) || ' status' || d || o_orderstatus || d || ' ' || chr(10) || 'end of part' || chr(10) ||
    'price' || d || price || d || o_orderpriority || chr(10) || 'customer' || d || CAST(o_custkey AS STRING) || chr(10) || chr(10) END AS text
FROM (SELECT o_orderkey AS doc_id, o_orderstatus, o_orderpriority, o_custkey,
    CASE o_orderkey % 6 WHEN 0 THEN chr(9) WHEN 1 THEN ',' WHEN 2 THEN '|' WHEN 3 THEN '    ' WHEN 4 THEN '  ' END AS d,
    CASE WHEN o_orderkey % 6 = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING)
      ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',' || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0') END AS price
  FROM {orders}) o
"""

# Raw cells, one sheet per order: a title, a merged header, a sub-header, one row per line.
CELL_GRID = """
SELECT sheet_id, CAST(0 AS INT) AS row_idx, CAST(0 AS INT) AS col_idx, 'Order ' || CAST(sheet_id AS STRING) AS value
FROM (SELECT o_orderkey AS sheet_id FROM {orders}) t
UNION ALL
SELECT sheet_id, CAST(1 AS INT), CAST(col_idx AS INT),
  CASE col_idx WHEN 0 THEN 'Line' WHEN 1 THEN 'Amount' WHEN 4 THEN 'Ship' WHEN 5 THEN 'Ship' END
FROM (SELECT o_orderkey AS sheet_id, <explode_columns> AS col_idx FROM {orders}) h
UNION ALL
SELECT sheet_id, CAST(2 AS INT), CAST(col_idx AS INT),
  CASE col_idx WHEN 1 THEN 'Net' WHEN 2 THEN 'Tax' WHEN 4 THEN 'Year' WHEN 5 THEN 'Year' END
FROM (SELECT o_orderkey AS sheet_id, <explode_columns> AS col_idx FROM {orders}) s
UNION ALL
SELECT sheet_id, CAST(2 + line_no AS INT), CAST(col_idx AS INT),
  CASE col_idx WHEN 0 THEN 'Line ' || CAST(line_no AS STRING) WHEN 1 THEN CAST(price AS STRING) WHEN 2 THEN CAST(tax AS STRING)
    WHEN 3 THEN CASE WHEN line_no % 3 = 0 THEN NULL ELSE CAST(quantity AS STRING) END
    WHEN 4 THEN CAST(ship_year AS STRING) ELSE CAST(ship_year + 1 AS STRING) END
FROM (SELECT l_orderkey AS sheet_id, l_linenumber AS line_no, <explode_columns> AS col_idx,
    SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, SUM(CAST(l_tax AS DECIMAL(18,2))) AS tax,
    SUM(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, CAST(MIN(year(l_shipdate)) AS INT) AS ship_year
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber) d
"""

# A parsed table with unnamed columns, padded and blank cells, and rows that hold one value only.
SPARSE_ORDERS = """
SELECT o_orderkey AS _ord,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' ELSE ' ' || o_orderpriority || '  ' END AS priority,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(CAST(year(o_orderdate) AS INT) AS STRING) END AS <q>__EMPTY<q>,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'status ' || o_orderstatus END AS <q>__EMPTY_1<q>,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS <q>EMPTY 2<q>,
  CASE WHEN o_orderkey % 2 = 0 THEN '' END AS <q>__EMPTY_3<q>,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS customer
FROM {orders}
"""

# Events with gaps: long runs of missing values, empty and null tags.
SPARSE_EVENTS = """
SELECT event_id, CAST(ts AS DATE) AS event_day, event_type, user_id,
  CASE WHEN event_id % 7 < 3 OR event_id % 1000 > 700 THEN NULL ELSE CAST(value AS DECIMAL(18,2)) END AS value,
  CASE WHEN event_id % 5 = 2 THEN '' WHEN event_id % 11 < 4 THEN NULL ELSE 'tag ' || CAST(user_id % 7 AS STRING) END AS tag
FROM {events}
"""

# One card per order: what a text column may hold, each with some wrong cells, repeated and constant columns.
CONTACT_CARDS = """
SELECT o_orderkey AS order_no,
  CASE WHEN o_orderkey % 25 = 0 THEN 'nobody at example' ELSE 'c' || CAST(o_custkey AS STRING) || '@example.com' END AS mail,
  CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE '+1 (555) ' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-0199' END AS telephone,
  'https://example.org/orders/' || CAST(o_orderkey AS STRING) AS page,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL
       ELSE substr(digest, 1, 8) || '-' || substr(digest, 9, 4) || '-4' || substr(digest, 14, 3) || '-a' || substr(digest, 18, 3) || '-' || substr(digest, 21, 12) END AS token,
  '4000 0000 0' || lpad(CAST(number AS STRING), 6, '0') || CAST((check_sum + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 10 AS STRING) AS card,
  CAST(o_orderkey % 90 AS STRING) || '.25, ' || CASE WHEN o_orderkey % 40 = 0 THEN '999.5' ELSE '-' || CAST(o_custkey % 180 AS STRING) || '.5' END AS place,
  '$' || CAST(1 + o_orderkey % 900 AS STRING) || ',' || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '.50' AS amount,
  CAST(o_orderkey % 100 AS STRING) || '%' AS share,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS agreed,
  CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey AS STRING) ELSE 'c' || CAST(o_custkey AS STRING) || '@example.com' END AS mixed,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'no' END AS consent,
  CAST(o_orderkey AS STRING) AS order_text,
  CAST(NULL AS STRING) AS nothing,
  CASE WHEN o_orderkey % 50 = 0 THEN 'web' ELSE 'shop' END AS channel,
  'EUR' AS unit,
  o_orderstatus AS status
FROM (SELECT o_orderkey, o_custkey, o_orderstatus, number, md5(CAST(o_orderkey AS STRING)) AS digest,
    (10 - (8 + d0 + d0 - CASE WHEN d0 > 4 THEN 9 ELSE 0 END + d1 + d2 + d2 - CASE WHEN d2 > 4 THEN 9 ELSE 0 END + d3
      + d4 + d4 - CASE WHEN d4 > 4 THEN 9 ELSE 0 END + d5) % 10) % 10 AS check_sum
  FROM (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderkey % 1000000 AS number, o_orderkey % 10 AS d0, CAST(floor(o_orderkey / 10) AS BIGINT) % 10 AS d1,
      CAST(floor(o_orderkey / 100) AS BIGINT) % 10 AS d2, CAST(floor(o_orderkey / 1000) AS BIGINT) % 10 AS d3,
      CAST(floor(o_orderkey / 10000) AS BIGINT) % 10 AS d4, CAST(floor(o_orderkey / 100000) AS BIGINT) % 10 AS d5 FROM {orders}) x) y
"""

# Order dates as people write them: one column day first, one month first, one that never says, with days that do not exist.
WRITTEN_DATES = """
SELECT order_no,
  CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN '31/02/' || y WHEN k < 6 THEN d || '/' || m || '/' || y WHEN k = 6 THEN d || ' ' || substr(word, 1, 3) || ' ' || y
       WHEN k = 7 THEN y || m || d WHEN k = 8 THEN 'soon' ELSE y || '-' || m || '-' || d || ' 10:30:00' END AS ordered,
  CASE WHEN k = 2 THEN ' ' WHEN k = 3 THEN word || ' ' || d || ', ' || y WHEN k = 4 THEN '13/13/' || y ELSE m || '-' || d || '-' || y END AS shipped,
  CASE WHEN k = 5 THEN y || '.' || m || '.' || d ELSE lpad(CAST(1 + order_no % 12 AS STRING), 2, '0') || '/' || m || '/' || y END AS billed
FROM (SELECT o_orderkey AS order_no, o_orderkey % 10 AS k, CAST(year(o_orderdate) AS STRING) AS y, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS m,
    lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS d,
    CASE month(o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June'
      WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS word
  FROM {orders}) t
"""

# One row per order, with the sums of its lines; money adds up exactly.
ORDER_SIZES = """
SELECT l_orderkey AS order_no, CAST(COUNT(*) AS DOUBLE) AS n_lines, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, MAX(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
FROM {lineitem} GROUP BY l_orderkey
"""

# Which names stand for which: every customer's name for the one before it, in runs of a hundred. Every seventh run closes
# its circle; every 53rd customer has a second target; some names are written with spaces and in small letters.
SYNONYMS = """
SELECT c_name AS variant, 'Customer#' || lpad(CAST(c_custkey - 1 AS STRING), 9, '0') AS canonical FROM {customer} WHERE c_custkey % 100 <> 0
UNION ALL SELECT c_name, 'Customer#' || lpad(CAST(c_custkey + 99 AS STRING), 9, '0') FROM {customer} WHERE c_custkey % 700 = 0
UNION ALL SELECT ' ' || lower(c_name) || ' ', 'customer#' || lpad(CAST(c_custkey - 2 AS STRING), 9, '0') FROM {customer} WHERE c_custkey % 53 = 0 AND c_custkey % 100 > 1
"""

ORDER_NAMES = """
SELECT o_orderkey AS order_no, CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN ' ' || upper(c_name) WHEN o_orderkey % 5 = 0 THEN lower(c_name) ELSE c_name END AS buyer
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

VIEWS = {
    "order_sizes": ORDER_SIZES,
    "synonyms": SYNONYMS,
    "order_names": ORDER_NAMES,
    "sparse_events": SPARSE_EVENTS,
    "contact_cards": CONTACT_CARDS,
    "written_dates": WRITTEN_DATES,
    "projects_raw": PROJECTS_RAW,
    "supplier_years": SUPPLIER_YEARS,
    "dirty_customers": DIRTY_CUSTOMERS,
    "event_facts": EVENT_FACTS,
    "line_facts": LINE_FACTS,
    "order_memos": ORDER_MEMOS,
    "cell_grid": CELL_GRID,
    "sparse_orders": SPARSE_ORDERS,
}

_EXPLODE = {"spark": "explode(array(0, 1, 2, 3, 4, 5))", "duckdb": "unnest([0, 1, 2, 3, 4, 5])"}


def _dialect(text: str, engine: str) -> str:
    quote = "`" if engine == "spark" else '"'
    return text.replace("<q>", quote).replace("<explode_columns>", _EXPLODE[engine])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = _dialect(VIEWS[name], "spark")
    used = {t: read(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    """The same view as a common table expression for the checking engine."""
    text = _dialect(VIEWS[name], "duckdb")
    return f"{name} AS ({re.sub(r'{(\w+)}', r'\1', text).strip()})"
