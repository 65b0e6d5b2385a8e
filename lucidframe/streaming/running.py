"""Reports over input that keeps arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.coerce import col_of, group_key, numeric_of


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; a timestamp without time zone is read as session time."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return df.withColumn(column, col_of(column).cast("timestamp"))
    return df


def window_totals(stream: DataFrame, time: str, measure: str, width: str, late: str, by: str | None = None) -> DataFrame:
    """(period, [by], total, count) per time window; rows later than `late` are left out.

    Partial sums combine before the shuffle, and state is one row per open
    window and group.
    """
    timed = event_time(stream, time).withWatermark(time, late)
    keys: list[Column] = [F.window(col_of(time), width).alias("w")]
    if by:
        keys.append(group_key(col_of(by)).alias(by))
    grouped = timed.groupBy(*keys).agg(F.sum(numeric_of(stream, measure)).alias("total"), F.count("*").alias("count"))
    return grouped.select(F.col("w.start").alias("period"), *([by] if by else []), "total", "count")


def drop_repeats(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """First row per key; a key is remembered for the watermark's width only."""
    return event_time(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def keep_totals(stream: DataFrame, keys: list[str], measure: str, path: str, checkpoint: str) -> StreamingQuery:
    """Start folding new input into partial totals under `path`; stops when the input at hand is read.

    Each batch writes its own folder and replaces it when it is run again after
    a failure, so nothing is counted twice and no state has to be kept.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        partial = batch.groupBy(*[col_of(k) for k in keys]).agg(F.sum(numeric_of(batch, measure)).alias("total"), F.count("*").alias("count"))
        partial.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(keys…, total, count) over everything folded in so far."""
    parts = spark.read.parquet(path)
    return parts.groupBy(*[col_of(k) for k in keys]).agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
