"""DuckDB SQL that the operators' queries are checked against, built from the operators' parameters."""

from __future__ import annotations

from . import mixing, secret_scans
from .url_filters import ADDRESS, LOWER, UPPER


def judged_urls(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
placed AS (
  SELECT row_number() OVER () AS rn, page_id,
    translate(regexp_extract(coalesce(url, ''), '{ADDRESS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{ADDRESS}', 2) AS path
  FROM pages),
hits AS (
  SELECT rn, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY rn ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
  FROM placed JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, '{default}') AS verdict
FROM placed LEFT JOIN hits ON placed.rn = hits.rn AND place = 1"""


def _raking(temper: dict[str, float], kept_share: float, rounds: int, tolerance: float, dealt: int = 12) -> str:
    """Common table expressions from `rows` (source, lang, topic, tokens) to `raked` (cell, tokens, weight)."""
    total = f"{kept_share} * (SELECT sum(tokens) FROM cells)"
    steps = ["cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM rows WHERE tokens > 0 GROUP BY ALL)"]
    for dim, power in temper.items():
        steps.append(f"parts_{dim} AS MATERIALIZED (SELECT {dim}, sum(tokens) AS held, pow(sum(tokens), {power}) AS part FROM cells GROUP BY {dim})")
        factor = "0.0"
        for i in range(dealt):
            whole = f"held <= {factor} * part"
            rest = f"({total} - coalesce(sum(held) FILTER (WHERE {whole}), 0)) / sum(part) FILTER (WHERE NOT ({whole}))"
            steps.append(f"factor_{dim}_{i} AS MATERIALIZED (SELECT greatest(coalesce({rest}, {factor}), {factor}) AS f FROM parts_{dim})")
            factor = f"(SELECT f FROM factor_{dim}_{i})"
        steps.append(f"target_{dim} AS MATERIALIZED (SELECT {dim}, least(held, {factor} * part) AS target_{dim} FROM parts_{dim})")
    joined = " ".join(f"JOIN target_{dim} USING ({dim})" for dim in temper)
    steps.append(f"round_0 AS MATERIALIZED (SELECT *, {kept_share} * tokens AS free, 1.0::DOUBLE AS off FROM cells {joined})")
    for step in range(rounds):
        last = f"(SELECT * REPLACE (0.0::DOUBLE AS off), (SELECT max(off) FROM round_{step}) > {tolerance} AS going FROM round_{step})"
        for dim in temper:
            name, by, t = f"round_{step}_{dim}", f"OVER (PARTITION BY {dim})", f"target_{dim}"
            sums = f"SELECT *, sum(CASE WHEN free >= {mixing.NEARLY} * tokens THEN tokens ELSE 0 END) {by} AS held, sum(CASE WHEN free >= {mixing.NEARLY} * tokens THEN 0 ELSE free END) {by} AS moving FROM {last}"
            factor = f"CASE WHEN moving > 0 AND {t} > held THEN ({t} - held) / moving ELSE {t} / (held + moving) END"
            new = f"CASE WHEN going THEN free * {factor} ELSE free END AS free, CASE WHEN going THEN greatest(off, abs((held + moving) / {t} - 1)) ELSE off END AS off"
            steps.append(f"{name} AS MATERIALIZED (SELECT * EXCLUDE (held, moving) REPLACE ({new}) FROM ({sums}))")
            last = name
        steps.append(f"round_{step + 1} AS MATERIALIZED (SELECT * EXCLUDE (going) FROM {last})")
    return ",\n".join([*steps, f"raked AS (SELECT *, least(free, tokens) AS weight FROM round_{rounds})"])


def _topic() -> str:
    count = lambda signs: f"(length(t) - length(translate(t, '{signs}', '')))"
    return (
        f"CASE WHEN 100 * {count('|')} > length(t) THEN 'table' WHEN 100 * {count('#$%&*')} > 5 * length(t) THEN 'noise' "
        f"WHEN 100 * {count('!')} > 5 * length(t) THEN 'shouting' ELSE 'prose' END"
    )


def mixed_rows(source: str = "documents") -> str:
    """(doc_id, source, lang, topic, tokens, probability, kept) of every row of a table."""
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce("text", '') AS t FROM {source}),
rows AS MATERIALIZED (
  SELECT doc_id, source, lang, {_topic()} AS topic, len(regexp_extract_all(t, '{mixing.WORD}')) AS tokens,
    ('0x' || md5('{mixing.SEED}' || coalesce(doc_id::VARCHAR, md5(t)))[1:12])::BIGINT / {float(1 << 48)} AS draw
  FROM texts),
{_raking(mixing.TEMPER, mixing.KEPT_SHARE, mixing.ROUNDS, mixing.TOLERANCE)},
chances AS (SELECT source, lang, topic, least(weight / tokens, 1.0) AS chance FROM raked)
SELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, round(coalesce(chance, 0.0), 9) AS probability, draw < coalesce(chance, 0.0) AS kept
FROM rows LEFT JOIN chances USING (source, lang, topic)"""


def _spans(n: int, rule: secret_scans.Rule) -> str:
    """List of (start, n, end, kind) of one rule's matches in t."""
    pattern = rule.pattern.replace("'", "''")
    before = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return (
        f"(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': ({before.format('p[1:i]')} + {before.format('m[1:i-1]')})::BIGINT, 'n': {n}, "
        f"'end': ({before.format('p[1:i]')} + {before.format('m[1:i]')})::BIGINT, 'kind': '{rule.kind}', 'long': length(v[i])}}), lambda s: s.long >= {rule.least}) "
        f"FROM (SELECT string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS v))"
    )


def secrets(rules: list[secret_scans.Rule] = secret_scans.RULES, source: str = "documents") -> str:
    """doc_id, counts, digest and list of the spans of every row of a table."""
    lists = " || ".join(_spans(n, rule) for n, rule in enumerate(rules))
    written = lambda found: f"array_to_string(list_transform({found}, lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"
    base = f"list_filter(found, lambda s: s.n < {sum(rule.base for rule in rules)})"
    counts = ", ".join(f"len(list_filter(found, lambda s: s.kind = '{rule.kind}'))::BIGINT AS n_{rule.kind}" for rule in rules if rule.base)
    return f"""
WITH texts AS (SELECT doc_id, coalesce("text", '') AS t FROM {source}),
scanned AS (SELECT doc_id, list_sort({lists}) AS found FROM texts)
SELECT doc_id, {counts}, sha256({written(base)}) AS base_sha256, {written('found')} AS spans
FROM scanned"""


def hard_negatives() -> str:
    return """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
      SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.q, v.q)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id
    ), positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id,
           row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""
