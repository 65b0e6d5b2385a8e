"""A quality score: how complete, valid, unique and sound a table is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from .semantics import semantic_types

DIMENSIONS = ("completeness", "validity", "uniqueness", "integrity")


def quality_score(df: DataFrame, columns: list[str] | None = None, keys: list[str] | None = None, rules: dict[str, Column] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """(dimension, good, all, score) of every dimension, and of `overall`, the weighted mean of those that have something to judge.

    completeness  filled cells, of all cells
    validity      cells that pass their column's semantic type, of the filled cells of columns where at least four in five do
    uniqueness    different rows (of `keys`, by default of all `columns`), of all rows
    integrity     rows that break none of `rules` (conditions that no row should meet), of all rows
    Scores go from 0 to 100. A dimension without anything to judge, such as integrity without rules, has a null score.
    """
    columns = columns or df.columns
    rules, weights = rules or {}, weights or {}
    types = semantic_types(df, columns)
    sure = F.col("confidence").isin("high", "medium")
    cells = types.agg(F.sum("filled").alias("filled"), F.sum(F.when(sure, F.col("matching"))).alias("valid"), F.sum(F.when(sure, F.col("filled"))).alias("typed")).first()
    broken = reduce(lambda a, b: a | b, (F.coalesce(rule, F.lit(False)) for rule in rules.values()), F.lit(False))
    rows = df.agg(F.count("*").alias("n"), F.count_if(~broken).alias("sound")).first()
    # A row is known by two digests of its cells, so whole texts are no shuffle keys. A missing cell differs from every text.
    parts = [F.coalesce(F.concat(F.lit("="), col_of(c).cast("string")), F.lit("-")) for c in keys or columns]
    different = df.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *reversed(parts)).alias("b")).distinct().count()
    found = {
        "completeness": (cells.filled or 0, rows.n * len(columns)), "validity": (cells.valid or 0, cells.typed or 0),
        "uniqueness": (different, rows.n), "integrity": (rows.sound, rows.n) if rules else (0, 0),
    }
    out = [(d, int(good), int(of), 100.0 * good / of if of else None) for d, (good, of) in found.items()]
    judged = [(score, weights.get(d, 1.0)) for d, _, _, score in out if score is not None]
    total = sum(w for _, w in judged)
    out.append(("overall", None, None, sum(s * w for s, w in judged) / total if total else None))
    return df.sparkSession.createDataFrame(out, "dimension string, good long, all long, score double")
