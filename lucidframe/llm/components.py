"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Ties the larger (large) or the not larger neighbours of every node to its smallest neighbour."""
    both = links.union(links.select("b", "a")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    tied = both.join(low, "a")
    if large:
        tied = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        tied = tied.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
    return tied.where("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Rounds needed grow with the logarithm of the number of nodes. Self-links and null ends are ignored;
    an empty link table gives an empty result.
    """
    links = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        links = written(_star(_star(links, large=True), large=False), instead_of=links)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()
