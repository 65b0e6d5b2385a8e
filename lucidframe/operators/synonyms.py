"""Merging of synonyms: spellings and names that stand for another one, through any number of steps.

A table of synonyms (variant, canonical) may hold chains (y for yes, yes for Yes!), variants with several targets and circles. What
each variant ends at is settled and reported before anything is changed; variants with several targets and those that lead
into a circle stay as they are. Keys ignore case, outer spaces and repeated inner ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col_of, squeeze_spaces, strip_spaces
from ..session import shared_folder


def key_of(cell: Column) -> Column:
    """What two spellings of one name share; null for missing and blank cells."""
    text = F.lower(squeeze_spaces(cell.cast("string")))
    return F.when(text != "", text)


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back, so that a loop's plan stays short and lost executors cost no rounds."""
    path = f"{shared_folder(df.sparkSession)}/synonyms-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def resolve(synonyms: DataFrame, variant: str = "variant", canonical: str = "canonical") -> DataFrame:
    """(variant, target, status) for every key of a variant that differs from its canonical name.

    status  merged    target is the name at the end of its chain
            conflict  several targets are given: nothing is merged into one of them, chains that lead here end here
            circle    the chain never ends
    Every round doubles the steps each pointer takes, so a chain of n steps needs log2(n) rounds. The nodes whose pointer has not come
    to an end are counted; once a round settles none of them, all that are left lead into a circle, since a longer chain
    would hold a node that the round settles. Of several spellings of a name, the least is the target.
    """
    pairs = synonyms.select(key_of(col_of(variant)).alias("node"), key_of(col_of(canonical)).alias("to"), strip_spaces(col_of(canonical).cast("string")).alias("spelling"))
    pairs = _kept(pairs).where("node IS NOT NULL AND to IS NOT NULL")  # kept first: every filter on a key would make the key up again
    names = pairs.groupBy("to").agg(F.min("spelling").alias("target"))
    ends = pairs.where("node <> to").groupBy("node").agg(F.min("to").alias("to"), (F.min("to") < F.max("to")).alias("several"))
    ends = _kept(ends)
    first = ends.where("NOT several").select("node", "to")
    pointers, left = first, None
    while True:
        ahead = pointers.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        pointers = _kept(pointers.join(ahead, "to", "left").select("node", F.coalesce("beyond", "to").alias("to")))
        going = pointers.join(first.select(F.col("node").alias("to")), "to", "left_semi").count()
        if going == 0 or going == left:
            break
        left = going
    circles = first.select(F.col("node").alias("to"), F.lit(True).alias("loops"))
    settled = pointers.join(circles, "to", "left").join(names, "to", "left")
    settled = settled.select(F.col("node").alias("variant"), F.when(F.col("loops").isNull(), F.col("target")).alias("target"), F.when(F.col("loops").isNull(), "merged").otherwise("circle").alias("status"))
    several = ends.where("several").select(F.col("node").alias("variant"), F.lit(None).cast("string").alias("target"), F.lit("conflict").alias("status"))
    return settled.unionByName(several)


def synonym_report(df: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """(variant, target, status, rows): what a merge of `column` would do, with the rows that hold each variant, 0 included."""
    held = df.groupBy(key_of(col_of(column)).alias("variant")).agg(F.count("*").alias("rows"))
    return resolved.join(held, "variant", "left").select("variant", "target", "status", F.coalesce("rows", F.lit(0)).alias("rows"))


def merge_synonyms(df: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """`df` with the cells of `column` whose key is merged replaced by their target; all other cells, rows and columns stay.

    A join by key: Spark broadcasts a small table of synonyms and splits the partition of a hot value where it is large.
    The key is a column of its own, since a sort by an expression makes it up again for every two rows it compares.
    """
    found = resolved.where("status = 'merged'").select(F.col("variant").alias("__variant"), F.col("target").alias("__target"))
    keyed = df.select("*", key_of(col_of(column)).alias("__key"))
    joined = keyed.join(found, F.col("__key") == F.col("__variant"), "left")
    cell = F.coalesce("__target", col_of(column).cast("string"))
    return joined.select(*(cell.alias(c) if c == column else col_of(c) for c in df.columns))
