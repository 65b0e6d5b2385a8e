"""Nested feature collections: {"features": [{"attributes": {...}}, ...]}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute name in the source, column name here, type.
ATTRIBUTES = (
    ("InfraYear", "infra_year", "int"),
    ("Region", "region", "string"),
    ("Province", "province", "string"),
    ("Municipality", "municipality", "string"),
    ("ImplementingOffice", "implementing_office", "string"),
    ("ProjectID", "project_id", "string"),
    ("ProjectDescription", "project_description", "string"),
    ("Program", "program", "string"),
    ("TypeofWork", "type_of_work", "string"),
    ("infra_type", "infra_type", "string"),
    ("Longitude", "longitude", "double"),
    ("Latitude", "latitude", "double"),
    ("ContractID", "contract_id", "string"),
    ("ABC", "abc", "double"),
    ("ContractCost", "contract_cost", "double"),
    ("CompletionDateOriginal", "completion_date_original", "bigint"),
    ("CompletionYear", "completion_year", "int"),
    ("Contractor", "contractor", "string"),
    ("FundingYear", "funding_year", "string"),
    ("LegislativeDistrict", "legislative_district", "string"),
    ("DistrictEngineeringOffice", "district_engineering_office", "string"),
    ("CompletionDateActual", "completion_date_actual", "string"),
    ("StartDate", "start_date", "string"),
)

COLLECTION_DDL = (
    "features array<struct<attributes: struct<" + ", ".join(f"{name}: {kind}" for name, _, kind in ATTRIBUTES) + ">>>"
)


class EmptyInputError(ValueError):
    """The input holds no records."""


def flatten(collections: DataFrame) -> DataFrame:
    """One row per feature, its attributes under their column names. Absent keys are null."""
    # An outer explode, filtered afterwards: for an inner one Spark adds a filter on the
    # array below it, and a column of documents would be parsed twice.
    features = collections.select(F.explode_outer("features").alias("f")).where("f IS NOT NULL")
    return features.select(*[F.col(f"f.attributes.{name}").alias(column) for name, column, _ in ATTRIBUTES])


def read_feature_collection(spark: SparkSession, path: str, require_rows: bool = True) -> DataFrame:
    """Read one or many collection files.

    A multi-line JSON document cannot be split, so parallelism comes from the
    number of files: land the result as Parquet before working on it.
    """
    rows = flatten(spark.read.schema(COLLECTION_DDL).option("multiLine", True).json(path))
    if require_rows and rows.isEmpty():
        raise EmptyInputError(f"no features found in {path}")
    return rows


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Flat newline-delimited records with the column names of this engine; splittable."""
    schema = ", ".join(f"{column} {kind}" for _, column, kind in ATTRIBUTES)
    return spark.read.schema(schema).json(path)


def to_documents(records: DataFrame) -> DataFrame:
    """Records back to collection documents, one feature each, in column `document`."""
    attributes = F.struct(*[F.col(column).alias(name) for name, column, _ in ATTRIBUTES])
    return records.select(F.to_json(F.struct(F.array(F.struct(attributes.alias("attributes"))).alias("features"))).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Parse a column of collection documents, each with any number of features."""
    # The test keeps the text a column of its own: from_json runs without generated code, and so would all that a text is
    # made of if Spark put it into from_json.
    parsed = F.when(F.col("document").isNotNull(), F.from_json("document", COLLECTION_DDL))
    return flatten(documents.select(parsed.alias("d")).select("d.features"))
