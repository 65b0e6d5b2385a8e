"""Incremental reports over the events table, read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import profiles, running
from . import sql_text as q
from .registry import register
from .views import read


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.select("event_id", "ts", "event_type", F.col("ts").cast("date").alias("event_day"), F.col("value").cast("decimal(18,2)").alias("value"))


@register("stream_running_totals", (), """
SELECT CAST(ts AS DATE) AS event_day, event_type, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(COUNT(*) AS BIGINT) AS count FROM events GROUP BY 1, 2""")
def stream_running_totals(spark, sf_dir):
    folder = f"{shared_folder(spark)}/running-{uuid.uuid4().hex}"
    keys = ["event_day", "event_type"]
    running.keep_totals(event_stream(spark, sf_dir), keys, "value", f"{folder}/totals", f"{folder}/checkpoint").awaitTermination()
    return running.read_totals(spark, f"{folder}/totals", keys).withColumn("total", F.col("total").cast("double"))


PROFILED = ["event_id", "user_id", "event_type", "value", "props", "odd"]
_ODD = "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'none' ELSE CAST(value AS VARCHAR) END"


def _column_sql(c: str) -> str:
    number = f"TRY_CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS "column", COUNT(*) AS rows, COUNT(*) FILTER (WHERE CAST({c} AS VARCHAR) <> '') AS filled, COUNT(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') AS missing,
  COUNT({number}) AS numbers, MIN({number}) AS min, MAX({number}) AS max, ROUND(AVG({number}), 6) AS mean, ROUND(STDDEV_POP({number}), 6) AS std FROM e"""


# Events arrive as eight files, two a batch. The sketches' estimates are compared with exact figures in the tests.
@register("stream_profile", (), f"WITH e AS (SELECT *, {_ODD} AS odd FROM events) " + q.union([_column_sql(c) for c in PROFILED]))
def stream_profile(spark, sf_dir):
    folder = f"{shared_folder(spark)}/profile-{uuid.uuid4().hex}"
    events = read(spark, sf_dir, "events").withColumn("odd", F.expr(_ODD.replace("VARCHAR", "STRING")))
    events.repartition(8, "event_id").write.parquet(f"{folder}/arriving")
    arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arriving")
    profiles.keep_profile(arriving, f"{folder}/parts", f"{folder}/checkpoint", PROFILED).awaitTermination()
    found = profiles.read_profile(spark, f"{folder}/parts").drop("distinct", "q1", "median", "q3")
    return found.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})
