"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# While a table is written: shuffles it was made by are deleted once it is there, the driver keeps short texts of its plans only, and
# Python workers are handed texts in batches of bounded size, however long the texts.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxPlanStringLength": "4000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local master without one, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def while_writing(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in _WHILE_WRITING}
    for key, value in _WHILE_WRITING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def columns_of(df: DataFrame, without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of `df`, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def among_least(key: Column, wanted: int, count: Column) -> Column:
    """Whether a digest of `key` is low enough to be among the `wanted` least of `count` distinct ones, with room to spare.

    A filter ahead of a ranking by the same digest: it changes no result and leaves the ranking a bounded number of rows.
    """
    share = 4.0 * wanted / count
    return F.xxhash64(key).cast("double") <= share * float(1 << 64) - float(1 << 63)


def _folder(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: short lineage that survives lost executors.

    A table that nothing else reads, such as the one a loop's last round has written, can be named in `instead_of`: it is deleted
    once the new one is there. The files left are deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with while_writing(spark):
        df.write.parquet(path)
    target, files = _folder(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if old := getattr(instead_of, "_written_to", None):
        target, files = _folder(spark, old)
        files.delete(target, True)
    return out
