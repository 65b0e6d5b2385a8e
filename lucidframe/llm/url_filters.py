"""URL filters by hash prefixes of host-suffix and path-prefix expressions. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import columns_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "://([^/?#]*)([^?#]*)"
PREFIX_HEX = 8  # 4 bytes of the digest decide which rules are compared in full


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, in lower case; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty where there is no host."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of a short list of rules; longer lists come as a table of these columns."""
    rows = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), rule, strict=True))) for rule in rules))
    return spark.range(1).select(F.inline(rows))


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every host suffix of up to `labels` labels with every path prefix of one of `lengths` characters."""
    parts = F.split(host, r"\.")
    counts = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels)))
    suffixes = F.transform(counts, lambda n: F.array_join(F.slice(parts, -n, n), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null where none fits) and verdict (the rule's, else `default`).

    A rule (host, path, verdict) fits its host and all subdomains if the path starts with the rule's. The rule of
    most characters wins, among those the one with the longer host, then `block`. Each distinct address is
    judged once, so a hot host costs no more than its distinct paths. Expressions are only made for label counts and
    path lengths that rules have; the rules are read for these numbers. A null url, or one without `://`, has empty
    host and path and fits no rule. Rules with a null field are ignored; an empty rule table leaves `default`.
    Other columns pass through; columns named host, path, rule or verdict are replaced.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    shape = rules.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    extra = columns_of(pages, without=("host", "path", "rule", "verdict"))
    placed = pages.select(*extra, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if shape.labels is None:
        return placed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    digest = F.sha2("expression", 256)
    prefix = F.substring(digest, 1, PREFIX_HEX)
    listed = rules.select(F.concat("host", F.lit("\n"), "path").alias("expression"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict")
    listed = listed.select(prefix.alias("prefix"), digest.alias("full"), "rule", "host_chars", "verdict")
    made = placed.select("host", "path").distinct().select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shape.labels, shape.lengths)).alias("expression"))
    made = made.select("host", "path", prefix.alias("prefix"), digest.alias("digest"))
    hits = made.join(listed, "prefix").where("digest = full")
    rank = F.struct(F.length("rule"), "host_chars", F.col("verdict") == "block", "rule", "verdict")
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    out = placed.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.select(*extra, "host", "path", "rule", "verdict")
