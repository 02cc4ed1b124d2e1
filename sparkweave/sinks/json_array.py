"""A table as one JSON array, written in parallel (SNK-2).

Every task writes its own part; the texts of the parts, in the order of their
names, are one JSON array: the first row opens it, every other starts with a
comma, the last closes it.  Which rows are first and last, where partitions may
be empty, is agreed on by one count over the partitions of a checkpoint; a task
that is run again writes the same part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.json import JSON_OPTIONS, encode_json
from sparkweave.session import shared_root

#: Names of parts have five digits; beyond, their order is not that of the parts.
MOST_PARTS = 100_000
_BITS = 33  # of monotonically_increasing_id below the partition's number


def write_json_array(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` as parts of one JSON array of objects (NULL fields left out);
    an empty table is ``[]``."""
    spark = df.sparkSession
    shared_root(spark)
    rows = df.select(encode_json(*[F.col(f"`{c}`") for c in df.columns]).alias("_json"))
    if rows.rdd.getNumPartitions() > MOST_PARTS:
        rows = rows.coalesce(MOST_PARTS)
    # A checkpoint keeps its partitions: counted and written rows are the same.
    rows = rows.checkpoint(eager=True).withColumn("_at", F.monotonically_increasing_id())
    ends = rows.agg(F.min("_at").alias("first"), F.max("_at").alias("last")).first()
    if ends["first"] is None:
        spark.createDataFrame([("[]",)], "value string").coalesce(1).write.mode(mode).text(path)
        return
    opened = F.when(F.col("_at") == ends["first"], "[").otherwise(",")
    closed = F.when(F.col("_at") == ends["last"], "]").otherwise("")
    rows.select(F.concat(opened, "_json", closed).alias("value")).write.mode(mode).text(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of an array written by ``write_json_array``, part by part: a row is a
    line, which its frame is taken off."""
    line = F.regexp_replace(F.regexp_replace("value", "^[\\[,]", ""), "\\]$", "")
    text = spark.read.text(path).select(line.alias("_json")).where(F.col("_json") != "")
    return text.select(F.from_json("_json", schema, JSON_OPTIONS).alias("_r")).select("_r.*")
