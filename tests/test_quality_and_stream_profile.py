"""The quality score and the profile of arriving input against plain figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucidframe.operators.quality import quality_score
from lucidframe.streaming import profiles

DDL = "id long, amount double, note string, kind string"


def rows(n, start=0):
    rng = np.random.default_rng(start + 1)
    return [(i, None if i % 11 == 0 else float(1e8 + rng.normal()), "" if i % 7 == 0 else str(i % 900) if i % 2 else "word", ["a", "b", None][i % 3]) for i in range(start, start + n)]


def check(got, data):
    out = {r.column: r for r in got.collect()}
    assert list(sorted(out)) == ["amount", "id", "kind", "note"] and all(r.rows == len(data) for r in out.values())
    for i, name in enumerate(["id", "amount", "note", "kind"]):
        cells = [r[i] for r in data if r[i] is not None and r[i] != ""]
        r = out[name]
        assert r.filled == len(cells) and r.missing == len(data) - len(cells) and r.distinct == pytest.approx(len(set(cells)), rel=0.03)
        numbers = np.array([float(c) for c in cells if not isinstance(c, str) or c.isdigit()])
        assert r.numbers == len(numbers)
        if not len(numbers):
            assert (r.min, r.mean, r.std, r.median) == (None,) * 4
            continue
        assert (r.min, r.max) == (numbers.min(), numbers.max()) and r["mean"] == pytest.approx(numbers.mean(), rel=1e-14) and r.std == pytest.approx(numbers.std(), rel=1e-6)
        for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")):
            place = np.searchsorted(np.sort(numbers), r[name], "left") / len(numbers), np.searchsorted(np.sort(numbers), r[name], "right") / len(numbers)
            assert place[0] - 0.01 <= q <= place[1] + 0.01


def test_profile_over_batches_equals_that_of_all_rows(spark, tmp_path):
    folder, parts, checkpoint = (str(tmp_path / n) for n in ("in", "parts", "checkpoint"))
    data = []
    for start, n in ((0, 3000), (3000, 10), (3010, 1), (4000, 5000)):
        data += rows(n, start)
        spark.createDataFrame(rows(n, start), DDL).repartition(2).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(folder)
        profiles.keep_profile(stream, parts, checkpoint).awaitTermination()
    profiles.keep_profile(spark.readStream.schema(DDL).parquet(folder), parts, checkpoint).awaitTermination()  # nothing new
    check(profiles.read_profile(spark, parts), data)
    check(profiles.merged_profile(profiles.partial_profile(spark.createDataFrame(data, DDL))), data)


def test_a_redone_batch_counts_once_and_empty_ones_do_not_matter(spark):
    df = spark.createDataFrame(rows(50), DDL)
    part, none = profiles.partial_profile(df), profiles.partial_profile(df.limit(0))
    one = {r.column: r for r in profiles.merged_profile(part).collect()}
    assert {r.column: r for r in profiles.merged_profile(part.unionByName(none)).collect()} == one
    empty = profiles.merged_profile(none).collect()
    assert all((r.rows, r.distinct, r.numbers, r["mean"], r.median) == (0, 0, 0, None, None) for r in empty) and len(empty) == 4


def scores(df, *args, **named):
    return {r.dimension: (r.good, r["all"], r.score) for r in quality_score(df, *args, **named).collect()}


def test_quality_of_a_small_table(spark):
    data = [(1, "a@b.co", "x"), (2, "c@d.org", ""), (3, "e@f.net", None), (4, "g@h.io", "y"), (5, "bad", "y"), (5, "bad", "y")]
    df = spark.createDataFrame(data * 1 + [(9, "i@j.de", "z"), (10, "k@l.de", "z"), (11, "m@n.de", "z"), (12, "o@p.de", "z")], "id int, mail string, note string")
    got = scores(df, ["mail", "note"], rules={"late": F.col("id") > 10, "unknown": F.lit(None).cast("boolean")}, weights={"integrity": 3.0})
    assert got["completeness"] == (18, 20, 90.0) and got["validity"] == (8, 10, 80.0) and got["integrity"] == (8, 10, 80.0)
    assert got["uniqueness"] == (9, 10, 90.0) and got["overall"][2] == pytest.approx((90 + 80 + 90 + 3 * 80) / 6)
    assert scores(df, ["note"])["integrity"] == (0, 0, None) and scores(df, ["note"], ["id"])["uniqueness"] == (9, 10, 90.0)


def test_quality_tells_missing_from_text_and_takes_empty_tables(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None), ("a", "")], "x string, y string")
    assert scores(df)["uniqueness"] == (4, 4, 100.0)
    assert scores(df.limit(0)) == {d: (0, 0, None) for d in ("completeness", "validity", "uniqueness", "integrity")} | {"overall": (None, None, None)}
