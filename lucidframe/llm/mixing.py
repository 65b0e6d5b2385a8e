"""Mixing sources to target weights by bounded iterative proportional fitting. DataFrame functions only.

Cells are the combinations of source, language and topic that the corpus holds: their table is reduced by grouped sums, and raking runs on it
alone. The topic is the table's own column where it has one, else the kind of text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import columns_of, written

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 24  # at most; they end earlier, at the tolerance
TOLERANCE = 1e-3
NEARLY = 1 - 1e-9  # a weight this near its cell's tokens is at the bound, whatever the last digit
KEPT_SHARE = 0.5
SEED = "mix"
CELL = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.7}


def tokens_of(text: Column) -> Column:
    """Number of words of a whole text; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of text it is, from the share of signs that only tables, noise or shouting have many of."""
    text = F.coalesce(text, F.lit(""))
    chars = F.length(text)
    count = lambda signs: chars - F.length(F.translate(text, signs, ""))
    return (
        F.when(100 * count("|") > chars, F.lit("table")).when(100 * count("#$%&*") > 5 * chars, F.lit("noise"))
        .when(100 * count("!") > 5 * chars, F.lit("shouting")).otherwise(F.lit("prose"))
    )


def _marginals(cells: DataFrame, temper: dict[str, float]) -> DataFrame:
    """(dim, tokens, part): what every value of every dimension holds, and that to the dimension's power."""
    sums = [cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens")).select(F.lit(dim).alias("dim"), "tokens", F.pow("tokens", F.lit(power)).alias("part")) for dim, power in temper.items()]
    return reduce(DataFrame.unionByName, sums)


def attainable_factors(cells: DataFrame, temper: dict[str, float], total: float) -> dict[str, float]:
    """Per dimension the factor f for which least(tokens, f * tokens ** power) adds up to `total` over its values.

    Values that would have to give more than they hold give all, and the rest is dealt out among the others anew, until no more
    do. Every round is one aggregate to a row per dimension.
    """
    marginals = written(_marginals(cells, temper))
    factors = dict.fromkeys(temper, 0.0)
    while True:
        whole = F.lit(False)
        for dim, factor in factors.items():
            whole = whole | ((F.col("dim") == dim) & (F.col("tokens") <= F.lit(factor) * F.col("part")))
        sums = marginals.groupBy("dim").agg(F.coalesce(F.sum(F.when(whole, F.col("tokens"))), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~whole, F.col("part"))), F.lit(0.0)).alias("parts"))
        found = {r.dim: max((total - r.held) / r.parts, factors[r.dim]) if r.parts else factors[r.dim] for r in sums.collect()}
        if all(f <= factors[dim] * (1 + 1e-12) for dim, f in found.items()):
            return factors
        factors = factors | found


def with_targets(cells: DataFrame, temper: dict[str, float], total: float) -> DataFrame:
    """`cells` with `target_<dim>`: what all cells of the same value are to give together, at most what they hold."""
    for dim, factor in attainable_factors(cells, temper, total).items():
        held = F.sum("tokens").over(Window.partitionBy(dim)).cast("double")
        cells = cells.withColumn(f"target_{dim}", F.least(held, F.lit(factor) * F.pow(held, F.lit(temper[dim]))))
    return cells


def rake(cells: DataFrame, dims: list[str], kept_share: float = KEPT_SHARE, tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """`cells` (one row per combination, with `tokens` and `target_<dim>`) with `weight`, tokens to take from each, and `off_<dim>`.

    Each step scales the weights of every value of one dimension to its target. A weight is at most the tokens of its cell: cells at that
    bound stay there, and the others are scaled to what is left, so weight / tokens is a probability. A round is one pass over
    every dimension, a window over its values; it is written, and rounds end once no step had to change a value by more than
    `tolerance`. `off_<dim>` is that share for the last round: the residual, above the tolerance only where targets exclude each other.
    """
    cells = cells.withColumn("free", F.lit(kept_share) * F.col("tokens"))
    table = None
    for _ in range(rounds):
        for dim in dims:
            by = Window.partitionBy(dim)
            bound = F.col("free") >= F.lit(NEARLY) * F.col("tokens")
            held = F.sum(F.when(bound, F.col("tokens")).otherwise(0).cast("double")).over(by)
            moving = F.sum(F.when(bound, 0.0).otherwise(F.col("free"))).over(by)
            cells = cells.withColumns({"held": held, "moving": moving})
            target = F.col(f"target_{dim}")
            rest = (F.col("moving") > 0) & (target > F.col("held"))
            factor = F.when(rest, F.try_divide(target - F.col("held"), F.col("moving"))).otherwise(F.try_divide(target, F.col("held") + F.col("moving")))
            off = F.abs(F.try_divide(F.col("held") + F.col("moving"), target) - 1)
            cells = cells.withColumns({"free": F.col("free") * F.coalesce(factor, F.lit(1.0)), f"off_{dim}": F.coalesce(off, F.lit(0.0))}).drop("held", "moving")
        table = cells = written(cells, instead_of=table)
        if (cells.agg(F.max(F.greatest(F.lit(0.0), *(F.col(f"off_{dim}") for dim in dims)))).first()[0] or 0.0) <= tolerance:
            break
    return cells.withColumn("weight", F.least("free", F.col("tokens").cast("double"))).drop("free")


def uniform_of(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _described(docs: DataFrame, id_col: str, text_col: str) -> dict[str, Column]:
    """The cell of a row (null source and language as empty strings), its tokens and the key of its draw."""
    text = F.col(text_col)
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang")}
    named["topic"] = F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    return named | {"tokens": tokens_of(text), "key": F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(text, F.lit(""))))}


def raked_cells(rows: DataFrame, temper: dict[str, float] | None = None, kept_share: float = KEPT_SHARE, **how) -> DataFrame:
    """The cells of rows with tokens, raked to the tempered and attainable marginals of `kept_share` of all tokens."""
    temper = TEMPER if temper is None else temper
    cells = written(rows.where("tokens > 0").groupBy(*CELL).agg(F.sum("tokens").alias("tokens")))
    total = kept_share * (cells.agg(F.sum("tokens")).first()[0] or 0)
    return rake(with_targets(cells, temper, total), list(temper), kept_share, **how)


def cell_chances(rows: DataFrame, **how) -> DataFrame:
    """(source, lang, topic, chance): the probability with which rows of a cell are kept."""
    return raked_cells(rows, **how).select(*CELL, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0)).alias("chance"))


def mixing_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", temper: dict[str, float] | None = None, **how) -> DataFrame:
    """(dim, value, tokens, target, weight, residual) of every value: what it holds, is to give and gives, and the share it is off."""
    temper = TEMPER if temper is None else temper
    cells = raked_cells(docs.select(*(c.alias(n) for n, c in _described(docs, id_col, text_col).items())), temper, **how)
    parts = [cells.groupBy(F.lit(dim).alias("dim"), F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens"), F.max(f"target_{dim}").alias("target"), F.sum("weight").alias("weight")) for dim in temper]
    return reduce(DataFrame.unionByName, parts).withColumn("residual", F.abs(F.try_divide("weight", "target") - 1))


def mix_to_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, **how) -> DataFrame:
    """(id, source, lang, topic, tokens, probability, kept) of every row.

    A row is kept with its cell's probability, decided by a digest of its id (of its text where the id is null), so
    repeated rows fare alike and a redone task decides the same. Rows without tokens weigh nothing: probability 0, not
    kept. Null or missing source and language count as an empty string; a column `topic`, if there is one, is used as it is. An
    empty table gives no rows.
    """
    rows = written(docs.select(F.col(id_col), *(c.alias(n) for n, c in _described(docs, id_col, text_col).items())))
    out = rows.join(cell_chances(rows, **how), list(CELL), "left").withColumn("chance", F.coalesce("chance", F.lit(0.0)))
    return out.select(id_col, *CELL, "tokens", F.round("chance", 9).alias("probability"), (uniform_of(F.col("key"), seed) < F.col("chance")).alias("kept"))


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, **how) -> DataFrame:
    """The rows of `docs` that `mix_to_weights` keeps, with their columns as they are, whatever their names."""
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    described = {own + n: c for n, c in _described(docs, id_col, text_col).items()}
    rows = docs.select("*", *(c.alias(n) for n, c in described.items()))
    chances = cell_chances(rows.select(*(F.col(own + n).alias(n) for n in (*CELL, "tokens"))), **how)
    out = rows.join(chances.withColumnsRenamed({n: own + n for n in (*CELL, "chance")}), [own + n for n in CELL])
    return out.where(uniform_of(F.col(own + "key"), seed) < F.col(own + "chance")).where(F.col(own + "tokens") > 0).select(*columns_of(docs))
