"""Generic table sources: Parquet views, JSON arrays and wrapped objects, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import suffix_repeats
from .feature_json import EmptyInputError, read_feature_collection
from .normalize import normalize_parsed


_FILE, _BLOCK, _PLACE = "__file", "__block", "__place"


class UnsupportedFormatError(ValueError):
    """No reader exists for this kind of file."""


def register_view(spark: SparkSession, path: str, name: str = "projects") -> DataFrame:
    df = spark.read.parquet(path)
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A normalized table of texts: unnamed columns named, cells trimmed, rows with one filled cell or none left out.

    Cells may be quoted, with quotes doubled and, if `multi_line`, line breaks inside; a file is then read by one task, so give
    False for large files that have no such cells. Every file begins with the same header; a repeated name gets a suffix.
    Rows are ordered by file and place in the file only to name a year column after its first cell; no sort is needed.
    """
    reader = spark.read.options(quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE")
    head = reader.option("header", False).csv(path).first()
    if head is None:
        raise EmptyInputError(f"{path} holds no rows")
    names = suffix_repeats([name if name and name.strip() else f"_c{i}" for i, name in enumerate(head)])
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    parsed = reader.option("header", True).schema(schema).csv(path)
    placed = parsed.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_PLACE))
    return normalize_parsed(placed, [_FILE, _BLOCK, _PLACE], require_rows=True).drop(_FILE, _BLOCK, _PLACE)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Newline-delimited objects. Give a schema on large input: inferring one reads everything twice."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return _not_empty(reader.json(path), path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, table_field: str | None = None) -> DataFrame:
    """A JSON document: an array of objects, or an object that wraps one.

    For an object, the first property that is an array of objects is the table;
    with none, the object itself is the one row. Inferred fields come sorted by
    name, so where several arrays exist name the one meant in `table_field`.
    """
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    if df.columns == ["_corrupt_record"]:
        raise UnsupportedFormatError(f"{path} is not a JSON table of objects")
    if not _starts_with_array(spark, path):
        df = unwrap(df, table_field)
    return _not_empty(df, path)


def _starts_with_array(spark: SparkSession, path: str) -> bool:
    first = spark.read.text(path).select(F.ltrim("value").alias("line")).where("line <> ''").first()
    return first is not None and first.line.startswith("[")


def unwrap(df: DataFrame, table_field: str | None = None) -> DataFrame:
    """Rows of the wrapped table, one input row per document."""
    if table_field is None:
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if not arrays:
            return df
        filled = df.agg(*[F.bool_or(F.size(F.col(f"`{a}`")) > 0).alias(a) for a in arrays]).first()
        arrays = [a for a in arrays if filled[a]]
        if not arrays:
            return df
        table_field = arrays[0]
    rows = df.select(F.explode(F.col(f"`{table_field}`")).alias("r"))
    return rows.select("r.attributes.*") if _is_feature_list(df, table_field) else rows.select("r.*")


def _is_feature_list(df: DataFrame, field: str) -> bool:
    element = df.schema[field].dataType.elementType
    return field == "features" and "attributes" in element.names and isinstance(element["attributes"].dataType, T.StructType)


def read_table(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """Read by format, or by the path's extension when none is given."""
    fmt = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    readers = {
        "parquet": lambda: spark.read.parquet(path),
        "csv": lambda: read_csv(spark, path, **options),
        "json": lambda: read_json(spark, path, **options),
        "ndjson": lambda: read_json_lines(spark, path, **options),
        "jsonl": lambda: read_json_lines(spark, path, **options),
        "features": lambda: read_feature_collection(spark, path),
    }
    if fmt not in readers:
        raise UnsupportedFormatError(f"unsupported format: {fmt}")
    return readers[fmt]()


def _not_empty(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInputError(f"{path} holds no rows")
    return df
