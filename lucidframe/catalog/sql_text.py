"""SQL fragments the checks share."""

from __future__ import annotations

SPACES = r"[\s\x0b\p{Z}\x{feff}]"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def squeeze(c: str) -> str:
    return strip(f"regexp_replace({c}, '{SPACES}+', ' ', 'g')")


def number(c: str) -> str:
    return f"(CASE WHEN regexp_matches({strip(c)}, '{NUMBER}') THEN TRY_CAST({strip(c)} AS DOUBLE) END)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def missing(c: str) -> str:
    return f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')"


def at_index(c: str, index: str, source: str) -> str:
    """The value at a 0-based position of the sorted values."""
    return f"(SELECT CAST(v AS DOUBLE) FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, COUNT(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL) WHERE i = {index})"


def fixed(c: str, digits: int) -> str:
    return f"CAST(CAST(ROUND({c}, {digits}) AS DECIMAL(30,{digits})) AS VARCHAR)"


def large_number(c: str) -> str:
    v = f"CAST({c} AS DOUBLE)"
    return (
        f"CASE WHEN ABS({v}) >= 1e9 THEN {fixed(f'{v} / 1e9', 2)} || 'B' WHEN ABS({v}) >= 1e6 THEN {fixed(f'{v} / 1e6', 1)} || 'M' "
        f"WHEN ABS({v}) >= 1e3 THEN {fixed(f'{v} / 1e3', 1)} || 'K' WHEN {v} = FLOOR({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) "
        f"ELSE {fixed(v, 2)} END"
    )


def column_facts(source: str, columns: list[str]) -> str:
    """One row per column with what the type rules need."""
    parts = []
    for i, c in enumerate(columns):
        t = f"CAST({c} AS VARCHAR)"
        full = f"NOT {missing(c)}"
        n = number(t)
        parts.append(
            f"SELECT {i} AS position, '{c}' AS col, COUNT(*) AS n, COUNT(*) FILTER (WHERE {full}) AS v, "
            f"COUNT(DISTINCT {t}) FILTER (WHERE {full}) AS u, COUNT({n}) FILTER (WHERE {full}) AS num, "
            f"COUNT(*) FILTER (WHERE {full} AND regexp_matches({t}, '^\\d{{4}}[-/]\\d{{2}}[-/]\\d{{2}}')) AS dated, "
            f"COALESCE(SUM(LENGTH({t})) FILTER (WHERE {full}), 0) AS len, "
            f"COUNT(*) FILTER (WHERE {n} < 1900 OR {n} > 2100) AS off_years FROM {source}"
        )
    return union(parts)


TIME_NAME = (
    "(regexp_matches(lower(col), 'date|time|month|day|quarter|week|created|updated') "
    "OR lower(col) IN ('year', 'fiscal_year', 'infra_year'))"
)


def column_types(source: str, columns: list[str]) -> str:
    return f"""SELECT position, col AS "column", CASE
    WHEN lower(col) = 'period' THEN 'temporal'
    WHEN regexp_matches(lower(col), '\\bid\\b') AND u > 0.8 * n THEN 'id'
    WHEN {TIME_NAME} AND v > 0 AND v >= 0.3 * n THEN 'temporal'
    WHEN dated > 0.5 * v THEN 'temporal'
    WHEN num > 0.7 * v AND u > 0.9 * n AND n > 20 THEN 'id'
    WHEN num > 0.7 * v AND {TIME_NAME} AND off_years = 0 THEN 'temporal'
    WHEN num > 0.7 * v THEN 'numeric'
    WHEN len / greatest(v, 1) > 100 OR (u > 0.8 * n AND n > 50) THEN 'text'
    ELSE 'categorical' END AS type, u AS unique_count, n - v AS null_count
  FROM ({column_facts(source, columns)})"""


def frequencies(source: str, columns: list[str]) -> str:
    return union(
        [
            f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, COUNT(*) AS count FROM {source} WHERE NOT {missing(c)} GROUP BY 2"
            for c in columns
        ]
    )
