"""Queries over contact records with mixed spellings, text numbers, blanks and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.coerce import col_of, currency_number, percent_number
from ..operators import cleaning, dedup, synonyms
from . import sql_text as q
from .registry import register, view
from .views import read

DIRTY = ("dirty_customers",)
COLUMNS = ["c_custkey", "segment", "balance_text", "rate_text", "note", "balance"]
TEXTS = ["segment", "balance_text", "rate_text", "note"]
NUMBERS = ["c_custkey", "balance"]


def dirty(spark, sf_dir):
    return view(spark, sf_dir, "dirty_customers")


FENCES_SQL = ", ".join(
    f"""{c}_q AS (SELECT n, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (
      SELECT COUNT({c}) AS n, {q.at_index(c, 'n // 4', 'src')} AS q1, {q.at_index(c, '(3 * n) // 4', 'src')} AS q3 FROM src))"""
    for c in NUMBERS
)
SQUEEZED_SQL = "squeezed AS (SELECT c_custkey, " + ", ".join(f"{q.squeeze(c)} AS {c}" for c in TEXTS) + ", balance FROM src)"


def merged_sql(columns: list[str]) -> str:
    def one(c: str) -> str:
        key = f"lower({q.strip(c)})"
        return (
            f"CASE WHEN {c} <> '' AND MIN({c}) OVER (PARTITION BY {key}) <> MAX({c}) OVER (PARTITION BY {key}) "
            f"THEN upper(left({key}, 1)) || substr({key}, 2) ELSE {c} END AS {c}"
        )

    rest = [c for c in COLUMNS if c not in columns]
    return f"merged AS (SELECT {', '.join(rest + [one(c) for c in columns])} FROM squeezed)"


@register("dedup_exact", DIRTY, "SELECT DISTINCT * FROM dirty_customers")
def dedup_exact(spark, sf_dir):
    return dedup.drop_exact_duplicates(dirty(spark, sf_dir))


@register("missing_report", DIRTY, q.union(
    [f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {q.missing(c)}) AS missing FROM dirty_customers" for c in COLUMNS]))
def missing_report(spark, sf_dir):
    return cleaning.missing_report(dirty(spark, sf_dir))


@register("outliers_iqr", DIRTY, "WITH src AS (SELECT * FROM dirty_customers), " + FENCES_SQL + q.union(
    [f"""SELECT '{c}' AS "column", n, q1, q3, lower, upper,
    (SELECT COUNT(*) FROM src WHERE {c} < (SELECT lower FROM {c}_q) OR {c} > (SELECT upper FROM {c}_q)) AS outliers FROM {c}_q""" for c in NUMBERS]))
def outliers_iqr(spark, sf_dir):
    return cleaning.outlier_report(dirty(spark, sf_dir))


@register("outliers_iqr_flagged", DIRTY, "WITH src AS (SELECT * FROM dirty_customers), " + FENCES_SQL + """
SELECT src.*, c_custkey < (SELECT lower FROM c_custkey_q) OR c_custkey > (SELECT upper FROM c_custkey_q) AS c_custkey_outlier,
  balance < (SELECT lower FROM balance_q) OR balance > (SELECT upper FROM balance_q) AS balance_outlier
FROM src""".replace("src.*", "c_custkey, segment, balance"))
def outliers_iqr_flagged(spark, sf_dir):
    flagged = cleaning.flag_outliers(dirty(spark, sf_dir))
    return flagged.select("c_custkey", "segment", "balance", "c_custkey_outlier", "balance_outlier")


@register("normalize_text", DIRTY, "WITH src AS (SELECT * FROM dirty_customers), " + SQUEEZED_SQL + " SELECT * FROM squeezed")
def normalize_text(spark, sf_dir):
    return cleaning.normalize_text(dirty(spark, sf_dir))


@register("normalize_text_report", DIRTY, q.union(
    [f"SELECT '{c}' AS \"column\", COUNT(*) FILTER (WHERE {q.squeeze(c)} <> {c}) AS changed_cells FROM dirty_customers" for c in TEXTS]))
def normalize_text_report(spark, sf_dir):
    return cleaning.normalize_text_report(dirty(spark, sf_dir))


@register("normalize_documents", (), f"SELECT doc_id, {q.squeeze('text')} AS text FROM documents")
def normalize_documents(spark, sf_dir):
    """The whitespace step over whole document texts."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return cleaning.normalize_text(documents)


@register("merge_case_variants", DIRTY, "WITH src AS (SELECT * FROM dirty_customers), " + SQUEEZED_SQL + ", " + merged_sql(["segment", "note"])
          + " SELECT c_custkey, segment, note, balance_text FROM merged")
def merge_case_variants(spark, sf_dir):
    squeezed = cleaning.normalize_text(dirty(spark, sf_dir))
    merged = cleaning.merge_case_variants(squeezed, ["segment", "note"])
    return merged.select("c_custkey", "segment", "note", "balance_text")


@register("merge_case_variants_map", DIRTY, "WITH src AS (SELECT * FROM dirty_customers), " + SQUEEZED_SQL + q.union([f"""
SELECT '{c}' AS "column", key, upper(left(key, 1)) || substr(key, 2) AS canonical FROM (
  SELECT lower({q.strip(c)}) AS key FROM squeezed WHERE {c} <> '' GROUP BY 1 HAVING COUNT(DISTINCT {c}) > 1)""" for c in TEXTS]))
def merge_case_variants_map(spark, sf_dir):
    return cleaning.case_variants(cleaning.normalize_text(dirty(spark, sf_dir)))


def percent_sql(c: str) -> str:
    return f"(CASE WHEN {q.strip(c)} LIKE '%\\%' ESCAPE '\\' THEN " + q.number(f"left({q.strip(c)}, -1)") + " / 100 END)"


def currency_sql(c: str) -> str:
    return f"(CASE WHEN regexp_matches({c}, '[$₱€£,]') THEN " + q.number(f"regexp_replace({c}, '[$₱€£,]', '', 'g')") + " END)"


@register("parse_percent", DIRTY, f"SELECT c_custkey, rate_text, {percent_sql('rate_text')} AS rate FROM dirty_customers")
def parse_percent(spark, sf_dir):
    return dirty(spark, sf_dir).select("c_custkey", "rate_text", percent_number(F.col("rate_text")).alias("rate"))


@register("parse_currency", DIRTY, f"SELECT c_custkey, balance_text, {currency_sql('balance_text')} AS amount FROM dirty_customers")
def parse_currency(spark, sf_dir):
    return dirty(spark, sf_dir).select("c_custkey", "balance_text", currency_number(F.col("balance_text")).alias("amount"))


def _names_where(counts: str) -> str:
    return f"(SELECT COALESCE(string_agg(c, ', ' ORDER BY i), '') FROM ({counts}) WHERE k > 0)"


def _counted(source: str, columns: list[str], condition) -> str:
    return q.union([f"SELECT {i} AS i, '{c}' AS c, COUNT(*) FILTER (WHERE {condition(c)}) AS k FROM {source}" for i, c in enumerate(columns)])


def _changed_by_merge(c: str) -> str:
    key = f"lower({q.strip(c)})"
    return (
        f"SELECT {TEXTS.index(c)} AS i, '{c}' AS c, COUNT(*) FILTER (WHERE {c} <> '' AND lo <> hi AND {c} <> upper(left(key, 1)) || substr(key, 2)) AS k "
        f"FROM (SELECT {c}, {key} AS key, MIN({c}) OVER (PARTITION BY {key}) AS lo, MAX({c}) OVER (PARTITION BY {key}) AS hi FROM squeezed)"
    )


_MISSING = _counted("src", COLUMNS, q.missing)
_OUTSIDE = _counted("src", NUMBERS, lambda c: f"{c} < (SELECT lower FROM {c}_q) OR {c} > (SELECT upper FROM {c}_q)")
_SQUEEZE = _counted("src", TEXTS, lambda c: f"{q.squeeze(c)} <> {c}")
_MERGE = q.union([_changed_by_merge(c) for c in TEXTS])
_NUMBERS = _counted("merged", TEXTS, lambda c: f"COALESCE({percent_sql(c)}, {currency_sql(c)}) IS NOT NULL")


@register("cleaning_report", DIRTY, "WITH src AS (SELECT DISTINCT * FROM dirty_customers), " + FENCES_SQL + ", " + SQUEEZED_SQL + ", " + merged_sql(TEXTS) + f"""
SELECT 'Remove duplicates' AS step, (SELECT COUNT(*) FROM dirty_customers) - (SELECT COUNT(*) FROM src) AS affected_rows, '{', '.join(COLUMNS)}' AS affected_columns
UNION ALL SELECT 'Fix column names', 0, ''
UNION ALL SELECT 'Handle missing values', 0, {_names_where(_MISSING)}
UNION ALL SELECT 'Detect outliers', 0, {_names_where(_OUTSIDE)}
UNION ALL SELECT 'Normalize text', (SELECT CAST(SUM(k) AS BIGINT) FROM ({_SQUEEZE})), {_names_where(_SQUEEZE)}
UNION ALL SELECT 'Clean categoricals', (SELECT CAST(SUM(k) AS BIGINT) FROM ({_MERGE})), {_names_where(_MERGE)}
UNION ALL SELECT 'Clean numbers', (SELECT CAST(SUM(k) AS BIGINT) FROM ({_NUMBERS})), {_names_where(_NUMBERS)}""")
def cleaning_report(spark, sf_dir):
    report = cleaning.clean_dataset(dirty(spark, sf_dir)).report
    return report.select("step", "affected_rows", F.array_join("affected_columns", ", ").alias("affected_columns"))


def _total(counts: str) -> str:
    return f"(SELECT COALESCE(SUM(k), 0)::BIGINT FROM ({counts}))"


def _columns_hit(counts: str) -> str:
    return f"(SELECT COUNT(*) FROM ({counts}) WHERE k > 0)"


@register("cleaning_report_text", DIRTY, "WITH src AS (SELECT DISTINCT * FROM dirty_customers), " + FENCES_SQL + f"""
SELECT 'Remove duplicates' AS step, 'Removed ' || ((SELECT COUNT(*) FROM dirty_customers) - (SELECT COUNT(*) FROM src)) || ' exact duplicate row(s)' AS description
UNION ALL SELECT 'Handle missing values', 'Found ' || {_total(_MISSING)} || ' missing value(s) across ' || {_columns_hit(_MISSING)} || ' column(s): '
  || (SELECT string_agg(c || '(' || k || ')', ', ' ORDER BY i) FROM ({_MISSING}) WHERE k > 0)
UNION ALL SELECT 'Detect outliers', CASE WHEN {_total(_OUTSIDE)} = 0 THEN 'No outliers detected in numeric columns'
  ELSE 'Flagged ' || {_total(_OUTSIDE)} || ' outlier value(s) in ' || {_columns_hit(_OUTSIDE)} || ' numeric column(s) using IQR method (not removed)' END""")
def cleaning_report_text(spark, sf_dir):
    """What the first and the two reporting steps say about themselves."""
    report = cleaning.clean_dataset(dirty(spark, sf_dir)).report
    return report.where(F.col("step").isin("Remove duplicates", "Handle missing values", "Detect outliers")).select("step", "description")


@register("fix_column_names", DIRTY, """SELECT c_custkey AS "customer key", note AS "note_text", segment AS "a b", balance AS "a b_1" FROM dirty_customers""")
def fix_column_names(spark, sf_dir):
    """Padded, broken and colliding names over the whole table."""
    messy = dirty(spark, sf_dir).select(F.col("c_custkey").alias("  customer\n  key "), F.col("note").alias("note_text"), F.col("segment").alias("a  b"), F.col("balance").alias("a b "))
    return cleaning.fix_column_names(messy)[0]


def number_text_sql(c: str) -> str:
    n = f"COALESCE({percent_sql(c)}, {currency_sql(c)})"
    return f"COALESCE(CASE WHEN {n} = FLOOR({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE CAST({n} AS VARCHAR) END, {c}) AS {c}"


@register("clean_dataset", DIRTY, "WITH src AS (SELECT DISTINCT * FROM dirty_customers), " + SQUEEZED_SQL + ", " + merged_sql(TEXTS)
          + f" SELECT c_custkey, {', '.join(number_text_sql(c) for c in TEXTS)}, balance FROM merged")
def clean_dataset(spark, sf_dir):
    """All seven steps; every cell of the cleaned table is compared."""
    return cleaning.clean_dataset(dirty(spark, sf_dir)).df.select(*[col_of(c) for c in COLUMNS])


def _key(c: str) -> str:
    return f"NULLIF(lower(regexp_replace(trim({c}), ' +', ' ', 'g')), '')"


# Every chain is walked to its end; the union drops repeats, so circles end too.
_RESOLVED = f"""
WITH RECURSIVE pairs AS (SELECT {_key('variant')} AS node, {_key('canonical')} AS til, trim(canonical) AS spelling FROM synonyms),
  names AS (SELECT til, MIN(spelling) AS target FROM pairs GROUP BY til),
  ends AS (SELECT node, MIN(til) AS til, MIN(til) < MAX(til) AS several FROM pairs WHERE node <> til GROUP BY node),
  walk AS (SELECT node, til FROM ends WHERE NOT several UNION SELECT w.node, e.til FROM walk w JOIN ends e ON w.til = e.node WHERE NOT e.several),
  last AS (SELECT node, til FROM walk WHERE til NOT IN (SELECT node FROM ends WHERE NOT several)),
  resolved AS (SELECT e.node AS variant, target, CASE WHEN several THEN 'conflict' WHEN last.til IS NULL THEN 'circle' ELSE 'merged' END AS status
    FROM ends e LEFT JOIN last ON e.node = last.node LEFT JOIN names ON last.til = names.til)"""


@register("synonym_report", ("synonyms", "order_names"), f"""{_RESOLVED}
SELECT variant, target, status, (SELECT COUNT(*) FROM order_names WHERE {_key('buyer')} = variant) AS rows FROM resolved""")
def synonym_report(spark, sf_dir):
    return synonyms.synonym_report(view(spark, sf_dir, "order_names"), "buyer", synonyms.resolve(view(spark, sf_dir, "synonyms")))


@register("merge_synonyms", ("synonyms", "order_names"), f"""{_RESOLVED}
SELECT order_no, COALESCE(target, buyer) AS buyer FROM order_names LEFT JOIN resolved ON {_key('buyer')} = variant AND status = 'merged'""")
def merge_synonyms(spark, sf_dir):
    return synonyms.merge_synonyms(view(spark, sf_dir, "order_names"), "buyer", synonyms.resolve(view(spark, sf_dir, "synonyms")))
