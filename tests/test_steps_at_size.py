"""Steps that decide how queries grow: what is gathered, kept or told apart once."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import functions as F

from lucidframe.catalog import model_queries
from lucidframe.operators import moments
from lucidframe.operators import profile as prof
from lucidframe.session import kept
from lucidframe.sources import grids


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _cells(spark):
    rows = [(s, 0, 0, f"Sheet {s}") for s in (1, 2)]
    for s in (1, 2):
        rows += [(s, 1, c, v) for c, v in enumerate(["Line", "Amount", None, None, "Ship", "Ship"])]
        rows += [(s, 2, c, v) for c, v in enumerate([None, "Net", "Tax", None, "Year", "Year"])]
        rows += [(s, r, c, v) for r in (3, 4) for c, v in enumerate([f"Line {r}", "10.5", "0.1", "4", "1996", "1997"])]
    rows += [(2, 1, 1, "Amount"), (2, 3, 1, "11.5"), (2, None, 0, "lost"), (2, 3, None, "lost")]  # a cell twice, cells without a place
    return spark.createDataFrame(rows, "sheet_id long, row_idx int, col_idx int, value string")


def test_headers_are_composed_without_sorting_cells(spark):
    found = grids.sheet_headers(_cells(spark))
    names = {s: [r.name for r in found.where(f"sheet_id = {s}").orderBy("col_idx").collect()] for s in (1, 2)}
    assert names[1] == names[2] == ["Line", "Amount Net", "Amount Tax", "Amount 3", "Ship Year", "Ship Year_1"]
    # One window is left, over names; there were four, and an aggregate of exploded cells after each.
    assert _plan(grids.sheet_headers(_cells(spark))).count("Window [") == 1


def test_grid_cells_gather_rows_once(spark):
    out = grids.grid_cells(_cells(spark))
    found = sorted((r.sheet_id, r.row_idx, r.col_idx, r.name, r.value, r.number) for r in out.collect())
    first = [(1, r, c, n, v, x) for r in (3, 4) for c, (n, v, x) in enumerate([
        ("Line", f"Line {r}", None), ("Amount Net", "10.5", 10.5), ("Amount Tax", "0.1", 0.1), ("Amount 3", "4", 4.0), ("Ship Year", "1996", 1996.0), ("Ship Year_1", "1997", 1997.0)])]
    assert [f for f in found if f[0] == 1] == first
    assert len([f for f in found if f[0] == 2]) == 13 and "lost" not in {f[4] for f in found}
    assert "Window [sheet_id" not in _plan(out) and all("/rows-" in f for f in out.inputFiles())


def test_a_first_row_with_a_cell_twice_names_its_column_twice(spark):
    rows = [(1, 0, 0, None), (1, 0, 0, None)] + [(1, r, c, f"{r}.5") for r in (1, 2) for c in (0, 1, 2)]
    cells = spark.createDataFrame(rows, "sheet_id long, row_idx int, col_idx int, value string")
    found = grids.grid_table(cells).where("row_idx = 1").collect()
    assert sorted((r.col_idx, r.name) for r in found) == [(0, "Column 1"), (0, "Column 1_1"), (1, "Column 2"), (2, "Column 3")]


def test_first_rows_travel_to_their_sheet_once(spark):
    out = grids.grid_table(_cells(spark))
    # Only rows further down join their names; there were the cells twice more, header work four times and names by window.
    assert _plan(out).count("Exchange hashpartitioning") + _plan(out).count("BroadcastExchange") <= 2
    assert "Window" not in _plan(out) and all("/rows-" in f for f in out.inputFiles())


def test_sheets_longer_than_the_first_rows_and_sheets_that_begin_below_them(spark):
    text = [(1, 0, c, v) for c, v in enumerate(["Name", "Year", "Name"])]  # a header, and data in and below the first rows
    rows = text + [(1, r, c, v) for r in range(1, 30) for c, v in enumerate(["x", "1.5", "2.5"])]
    rows += [(2, r, c, f"{r}.5") for r in range(3, 16) for c in range(3)]  # numbers only: rejected, named by row 3
    rows += [(3, 14, 0, "Far"), (3, 14, 2, "Far")] + [(3, r, c, f" {r} ") for r in (15, 17) for c in range(3)]  # begins at row 14
    rows += [(4, 12, 1, "lost"), (4, 13, 1, "1"), (None, 0, 0, "a"), (None, 0, 1, "b"), (None, 1, 0, "c"), (None, 1, 1, "d")]
    cells = spark.createDataFrame(rows, "sheet_id long, row_idx int, col_idx int, value string").repartition(3)
    found = sorted((r.sheet_id, r.row_idx, r.col_idx, r.name, r.value) for r in grids.grid_table(cells).collect())
    wanted = [(1, r, c, n, v) for r in range(1, 30) for c, (n, v) in enumerate([("Name", "x"), ("Year", "1.5"), ("Name_1", "2.5")])]
    wanted += [(2, r, c, n, f"{r}.5") for r in range(4, 16) for c, n in enumerate(["3.5", "3.5_1", "3.5_2"])]
    assert found == wanted + [(3, r, c, n, str(r)) for r in (15, 17) for c, n in enumerate(["Far", "Column 2", "Far_1"])]
    assert {r.sheet_id for r in grids.grid_cells(cells).collect()} == {1, 2}
    names = {(r.sheet_id, r.data_from, r.col_idx, r.name) for r in grids.accepted_headers(cells).collect()}
    assert {(1, 1, 2, "Name_1"), (2, 4, 1, "3.5_1"), (3, 15, 2, "Far_1"), (4, 13, 0, "Column 1"), (4, 13, 1, "lost"), (None, 1, 0, "Column 1")} <= names


def test_what_is_kept_leaves_no_shuffle_behind(spark):
    on_disk = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = on_disk()
    out = kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 30
    while on_disk() - before and time.time() < until:
        time.sleep(0.1)
    assert not on_disk() - before and out.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_models_add_lines_up_once(spark, tmp_path):
    lines = [(o, n, 5.0 * n, 10.0 * o, "R" if o % 2 else "N") for o in range(6) for n in range(1, o + 2)]
    table = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = model_queries.sizes(spark, str(tmp_path))
    assert "Aggregate" not in _plan(rows)
    assert sorted((r.order_no, r.n_lines, r.quantity, r.returned) for r in rows.collect())[1] == (1, 2.0, 15.0, 1)
    clusters = model_queries.kmeans_clusters(spark, str(tmp_path))
    assert "l_orderkey" not in _plan(clusters) and clusters.count() == 6


def test_rank_counts_are_kept(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (None,)], "x double")
    ranks = moments.mid_ranks(df, ["x"])[0]
    assert "HashAggregate" not in _plan(ranks)
    assert {r.value: r.rank for r in ranks.collect()} == {1.0: 1.0, 2.0: 2.5}


def test_short_values_stand_for_themselves(spark):
    long, digest = "x" * 40, "0123456789abcdef0123456789abcdef"
    df = spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("a", 2, None), (long, 2, None), (long, None, None), (digest, None, None)], "t string, n int, d timestamp")
    values = {r.value for r in prof._distinct_table(df, ["t", "n"]).collect()}
    assert {"a", "1", "2"} < values and long not in values and digest not in values
    assert {r.column: r.unique_count for r in prof.distinct_counts(df).collect()} == {"t": 3, "n": 2, "d": 1}
