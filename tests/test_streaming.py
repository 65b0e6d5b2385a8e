from __future__ import annotations

import datetime as dt

from lucidframe.streaming import running

DDL = "id int, at timestamp_ntz, kind string, amount int"


def batch(spark, folder, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(minutes=m), k, a) for i, m, k, a in rows]
    spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(DDL).parquet(folder)


def test_totals_over_two_runs(spark, tmp_path, rows_of):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "totals", "checkpoint"))
    batch(spark, folder, [(1, 0, "a", 5), (2, 1, "b", 7)])
    running.keep_totals(stream(spark, folder), ["kind"], "amount", out, checkpoint).awaitTermination()
    batch(spark, folder, [(3, 2, "a", 1)])
    running.keep_totals(stream(spark, folder), ["kind"], "amount", out, checkpoint).awaitTermination()
    # Nothing new: nothing is counted twice.
    running.keep_totals(stream(spark, folder), ["kind"], "amount", out, checkpoint).awaitTermination()
    assert rows_of(running.read_totals(spark, out, ["kind"]).select("kind", "total", "count")) == [("a", 6, 2), ("b", 7, 1)]


def run(spark, df, tmp_path, name):
    out = str(tmp_path / name)
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def test_windows_close_after_the_watermark(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch(spark, folder, [(1, 0, "a", 5), (2, 4, "a", 7), (3, 6, "b", 1), (4, 120, "a", 2)])
    got = run(spark, running.window_totals(stream(spark, folder), "at", "amount", "5 minutes", "10 minutes", "kind"), tmp_path, "out")
    assert sorted((r["kind"], r["total"], r["count"]) for r in got.collect()) == [("a", 12, 2), ("b", 1, 1)]


def test_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    batch(spark, folder, [(1, 0, "a", 5), (1, 1, "a", 5), (2, 2, "a", 5)])
    got = run(spark, running.drop_repeats(stream(spark, folder), ["id"], "at", "1 hour"), tmp_path, "out")
    assert sorted(r["id"] for r in got.collect()) == [1, 2]
