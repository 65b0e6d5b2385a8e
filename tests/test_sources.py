from __future__ import annotations

import json

import pytest

from lucidframe.sources import feature_json, grids, normalize, sinks, tables, text_tables
from lucidframe.sources.feature_json import EmptyInputError
from lucidframe.sources.tables import UnsupportedFormatError


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_feature_collection(spark, tmp_path):
    doc = {"features": [{"attributes": {"ProjectID": "A", "ABC": 2.5, "Extra": 1}}, {"attributes": {"ProjectID": "B"}}]}
    df = feature_json.read_feature_collection(spark, write(tmp_path / "a.json", json.dumps(doc, indent=1)))
    assert [(r["project_id"], r["abc"], r["region"]) for r in df.orderBy("project_id").collect()] == [("A", 2.5, None), ("B", None, None)]
    assert len(df.columns) == 23
    with pytest.raises(EmptyInputError):
        feature_json.read_feature_collection(spark, write(tmp_path / "b.json", '{"features": []}'))


def test_documents_round_trip(spark, rows_of):
    ddl = ", ".join(f"{column} {kind}" for _, column, kind in feature_json.ATTRIBUTES)
    row = {column: None for _, column, _ in feature_json.ATTRIBUTES} | {"project_id": "A", "abc": 1.5, "infra_year": 2020}
    df = spark.createDataFrame([tuple(row.values())], ddl)
    assert rows_of(feature_json.from_documents(feature_json.to_documents(df))) == rows_of(df)


def test_records(spark, tmp_path):
    path = write(tmp_path / "r.json", '{"project_id": "A", "abc": 1}\n{"region": "R"}\n')
    assert feature_json.read_records(spark, path).count() == 2


def test_json_tables(spark, tmp_path):
    array = tables.read_json(spark, write(tmp_path / "array.json", '[{"a": 1}, {"a": 2, "b": [{"c": 1}]}]'))
    assert array.count() == 2 and array.columns == ["a", "b"]
    wrapped = tables.read_json(spark, write(tmp_path / "wrapped.json", '{"total": 2, "empty": [], "rows": [{"a": 1}, {"a": 2}]}'))
    assert [r["a"] for r in wrapped.orderBy("a").collect()] == [1, 2]
    single = tables.read_json(spark, write(tmp_path / "single.json", '{"a": 1, "b": [1, 2]}'))
    assert single.count() == 1 and single.columns == ["a", "b"]
    named = tables.read_json(spark, write(tmp_path / "two.json", '{"x": [{"a": 1}], "y": [{"b": 1}, {"b": 2}]}'), table_field="y")
    assert named.columns == ["b"] and named.count() == 2
    features = tables.read_json(spark, write(tmp_path / "f.json", '{"features": [{"attributes": {"q": 1}}]}'))
    assert features.columns == ["q"]
    with pytest.raises(EmptyInputError):
        tables.read_json(spark, write(tmp_path / "none.json", "[]"), schema="a int")


def test_csv_and_formats(spark, tmp_path):
    df = tables.read_table(spark, write(tmp_path / "t.csv", "a,b,,\n1, ,2001,some\n 2 ,x,2002,other\n3,,,\n"))
    assert dict(df.dtypes) == dict.fromkeys(["a", "b", "Year_2001", "Category"], "string")
    assert sorted(map(tuple, df.collect())) == [("1", None, "2001", "some"), ("2", "x", "2002", "other")]
    with pytest.raises(EmptyInputError):
        tables.read_table(spark, write(tmp_path / "empty.csv", "a,b\n"))
    with pytest.raises(UnsupportedFormatError):
        tables.read_table(spark, "report.docx")
    assert tables.read_table(spark, write(tmp_path / "t.ndjson", '{"a": 1}\n{"a": 2}\n')).count() == 2
    sinks.write_parquet(df, str(tmp_path / "t.parquet"))
    tables.register_view(spark, str(tmp_path / "t.parquet"), "projects")
    assert tables.run_sql(spark, "SELECT count(*) AS n FROM projects").first()["n"] == 2


def detect(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    detected = text_tables.detect_tables(docs)
    shapes = {r["doc_id"]: r for r in text_tables.table_shapes(detected).collect()}
    cells = {}
    for r in text_tables.table_cells(detected).orderBy("doc_id", "row", "col").collect():
        cells.setdefault(r["doc_id"], []).append((r["row"], r["header"], r["value"], r["number"]))
    return shapes, cells


def test_text_tables(spark):
    shapes, cells = detect(
        spark,
        "a\tb\n1\t2\n\n3\tx",
        "Title\nname, price\nx, 3\nnothing here\n, \ny, 4",
        "a|b|c\n1|2,500|",
        "name    total\nA b    1,200\nC    5",
        "some  head\nplain\nx  1",
        "just prose\nand more prose\nand an end",
        "one line, only",
        "a,b\n",
    )
    assert {i: r["separator"] for i, r in shapes.items()} == {0: "tab", 1: "comma", 2: "pipe", 3: "spaces", 4: "double_space", 5: None, 6: None, 7: None}
    assert cells[0] == [(0, "a", "1", 1.0), (0, "b", "2", 2.0), (1, "a", "3", 3.0), (1, "b", "x", None)]
    assert shapes[1]["header_line"] == 1 and [c[2] for c in cells[1]] == ["x", "3", "y", "4"]
    assert cells[2] == [(0, "a", "1", 1.0), (0, "b", "2,500", 2500.0), (0, "c", None, None)]
    assert cells[3][:2] == [(0, "name", "A b", None), (0, "total", "1,200", 1200.0)]
    assert shapes[4]["row_count"] == 1 and shapes[5]["headers"] is None


def grid(spark, *sheets):
    cells = [(s, r, c, v) for s, rows in enumerate(sheets) for r, row in enumerate(rows) for c, v in enumerate(row)]
    return spark.createDataFrame(cells, "sheet_id int, row_idx int, col_idx int, value string").repartition(3)


REPORT = [
    ["Report", None, None, None, None],
    ["Nation", "Customers", None, "Suppliers", "Suppliers"],
    [None, "Count", "Balance", "Count", "Count"],
    ["X", "1", "2", "3", "4"],
    ["Y", None, "", None, None],
    ["Z", "5", "6", "7", "8"],
]
YEARS = [["Particulars", "1990", "1991", "1992"], ["APT", "782", "671", "25270"], ["BOT", "5", "6", "7"]]
GAPS = [["Total", None, None, "Cost", None], ["x", "1", "2", "3", "4"], ["y", "1", "2", "3", "4"]]


def test_grid_headers(spark):
    cells = grid(spark, REPORT, YEARS, GAPS, [["a", "b"], ["c", "d"]])
    found = {r["sheet_id"]: r for r in grids.header_rows(cells).collect()}
    assert set(found) == {0, 1, 2}
    assert (found[0]["header_row"], found[0]["score"], found[0]["is_subheader"], found[0]["data_from"]) == (1, 15, True, 3)
    assert (found[1]["header_row"], found[1]["is_subheader"]) == (0, False)
    names = {}
    for r in grids.sheet_headers(cells).orderBy("sheet_id", "col_idx").collect():
        names.setdefault(r["sheet_id"], []).append(r["name"])
    assert names[0] == ["Nation", "Customers Count", "Customers Balance", "Suppliers Count", "Suppliers Count_1"]
    assert names[1] == ["Particulars", "1990", "1991", "1992"]
    assert names[2] == ["Total", "Total 2", "Total 3", "Cost", "Cost 2"]


def test_grid_cells(spark, rows_of):
    cells = grid(spark, REPORT, YEARS, GAPS)
    found = rows_of(grids.grid_cells(cells))
    assert {(r[1], r[3], r[5]) for r in found if r[0] == 0 and r[3] == "Customers Balance"} == {(3, "Customers Balance", 2.0), (5, "Customers Balance", 6.0)}
    # Empty cells are normally just not there.
    sparse = cells.where("value IS NOT NULL")
    assert rows_of(grids.sheet_headers(sparse).select("sheet_id", "col_idx", "name")) == rows_of(grids.sheet_headers(cells).select("sheet_id", "col_idx", "name"))
    assert rows_of(grids.grid_cells(sparse)) == [r for r in found if r[4] is not None]


def test_grid_table_falls_back_to_the_first_row(spark, rows_of):
    rejected = [["1.5", "2.5", "3.5", "x"], ["10", " 20 ", "30", "40"], ["11", "21", "", "41"], ["12", "", "", ""]]
    cells = grid(spark, REPORT, rejected)
    table = grids.grid_table(cells)
    assert {r["name"] for r in table.where("sheet_id = 1").collect()} == {"1.5", "2.5", "3.5", "x"}
    assert rows_of(table.where("sheet_id = 1 AND col_idx = 1"), "row_idx", "value") == [(1, "20"), (2, "21")]
    assert rows_of(table.where("sheet_id = 0 AND row_idx = 3"), "value") == [("1",), ("2",), ("3",), ("4",), ("X",)]


def test_grid_table_keeps_columns_beyond_a_short_first_row(spark, rows_of):
    titled = [["Order 7", None, None, None], ["10", "20", "30", "40"], ["11", "21", None, "41"], ["12", "22", "32", None]]
    for cells in (grid(spark, titled), grid(spark, titled).where("value IS NOT NULL")):
        table = grids.grid_table(cells).where("value IS NOT NULL")
        assert {(r["col_idx"], r["name"]) for r in table.collect()} == {(0, "Order 7"), (1, "Column 2"), (2, "Column 3"), (3, "Column 4")}
        assert rows_of(table, "row_idx", "col_idx", "value") == [(r, c, v) for r, row in enumerate(titled) for c, v in enumerate(row) if r and v is not None]


def test_garbage_headers(spark):
    headers = [(0, h) for h in ("782", "671.5", "4/", "name")] + [(1, h) for h in ("1990", "1991", "name")] + [(2, h) for h in ("1", "2")]
    df = spark.createDataFrame(headers, "sheet_id int, header string")
    assert {r["sheet_id"]: r["rejected"] for r in grids.header_quality(df).collect()} == {0: True, 1: False, 2: False}


def test_normalize_parsed(spark):
    rows = [(0, " a ", "2001", "some text", "5", None, "x" * 40), (1, "", "2002", None, "6", " ", ""), (2, None, None, None, "7", None, None)]
    df = spark.createDataFrame(rows, "_ord int, name string, `__EMPTY` string, `__EMPTY_1` string, ` EMPTY 2` string, `__EMPTY_3` string, `EMPTY` string")
    out = normalize.normalize_parsed(df, ["_ord"])
    assert out.columns == ["_ord", "name", "Year_2001", "Category", "Category Amount", "Label"]
    got = [tuple(r) for r in out.orderBy("_ord").collect()]
    assert got == [(0, "a", "2001", "some text", "5", "x" * 40), (1, None, "2002", None, "6", None)]
    with pytest.raises(EmptyInputError):
        normalize.normalize_parsed(df.where("_ord = 2"), ["_ord"], require_rows=True)


def test_unnamed_pattern():
    assert [normalize.is_unnamed(n) for n in ("__EMPTY", "__EMPTY_12", "empty", "EMPTY 3", "Name", "EMPTY cell")] == [True, True, True, True, False, False]


def test_csv_as_people_write_it(spark, tmp_path):
    text = 'name,note,price,price,price\nann,"say ""hi"", ok",3,4,5\nbob,"two\nlines",1,,\n"","",7,"",8\n'
    df = tables.read_table(spark, write(tmp_path / "t.csv", text))
    assert df.columns == ["name", "note", "price", "price_1", "price_2"]
    assert sorted(map(tuple, df.collect()), key=repr) == [("ann", 'say "hi", ok', "3", "4", "5"), ("bob", "two\nlines", "1", None, None), (None, None, "7", None, "8")]
    flat = tables.read_table(spark, write(tmp_path / "u.csv", 'a,a\n"x ""y""",1\n'), multi_line=False)
    assert flat.columns == ["a", "a_1"] and [tuple(r) for r in flat.collect()] == [('x "y"', "1")]
    with pytest.raises(EmptyInputError):
        tables.read_table(spark, write(tmp_path / "none.csv", ""))


def test_texts_are_made_before_they_are_parsed(spark):
    records = spark.range(4).selectExpr(*[f"CAST(CASE WHEN id <> 2 THEN id END AS {kind}) AS {column}" for _, column, kind in feature_json.ATTRIBUTES])
    documents = feature_json.to_documents(records)
    out = feature_json.from_documents(documents)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert [("from_json" in line, "StructsToJson" in line) for line in plan if "from_json" in line or "StructsToJson" in line] == [(True, False), (False, True)]
    assert sorted(map(repr, out.collect())) == sorted(map(repr, records.collect()))
    others = spark.createDataFrame([(None,), ("",), ("{}",), ('{"features": []}',), ('{"features": [{"attributes": {"Region": "I"}}, {}, null]}',)], "document string")
    assert sorted(str(r.region) for r in feature_json.from_documents(others).collect()) == ["I", "None"]
