"""Writing results: Parquet tables, JSON reports, drill-down folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of
from ..functions.labels import slug


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, path: str, single_file: bool = False, mode: str = "overwrite") -> None:
    """JSON lines, whole numbers as numbers, nulls kept. `single_file` is for reports of a fixed small size."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_drilldown(df: DataFrame, key: str, path: str, rank_by: str = "total_cost", mode: str = "overwrite") -> None:
    """One folder per key (`slug=<name>`), ranked inside, from one job however many keys there are."""
    named = df.withColumn("slug", slug(col_of(key)))
    ranked = named.repartition("slug").sortWithinPartitions("slug", F.desc(rank_by))
    ranked.write.mode(mode).partitionBy("slug").option("ignoreNullFields", "false").json(path)
