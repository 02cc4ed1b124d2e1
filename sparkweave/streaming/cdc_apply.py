"""Applying a change log by key: inserts, updates and deletes (SRC-14, SNK-18, FLT-8).

``apply_changes`` streams a folder of changes (``op, seq, ts`` plus the whole row
image) into a keyed aggregation whose state holds the newest change of every
key, deletes included: a tombstone keeps an older change that arrives later
from bringing a row back.  Spark combines the changes of a key inside each task
before the shuffle, so a key with a third of all changes reaches its state as
one row a task and micro-batch.

Each micro-batch publishes the keys it touched, as they then are, under its
batch id and overwrites that on replay.  What is published of a key never goes
back in sequence, so the current table is the newest published row of each key
without the deleted ones.  ``compact`` folds what is published into a base, so
that readers need not go through all batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkweave import fs
from sparkweave.operators.upsert import latest_per_key
from sparkweave.streaming.cdc import change_schema

OPS = ("insert", "update", "delete")
_CHANGE = "_change"


def _valid(keys: list[str]) -> Column:
    """A change can be applied if its operation is known, and its key and its
    sequence number are there."""
    ok = F.coalesce(F.col("op").isin(*OPS), F.lit(False)) & F.col("seq").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    return ok


def published_schema(row_schema: T.StructType) -> T.StructType:
    return T.StructType([*row_schema.fields, T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()),
                         T.StructField("batch", T.LongType())])


def newest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The newest change of each key (batch or stream).  Of changes with the same
    sequence number a hash of the row decides, wherever they arrive."""
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct(F.col("seq"), F.xxhash64(*changes.columns))
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias(_CHANGE))
    return newest.select(*keys, f"{_CHANGE}.*").select(*changes.columns)


def _publish(out_root: str, columns: list[str]):
    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.select(*columns, "op", "seq").write.mode("overwrite").parquet(f"{out_root}/changes/batch={batch_id}")

    return publish


def apply_changes(spark: SparkSession, changes_path: str, row_schema: T.StructType, key: str | list[str], out_root: str,
                  max_files_per_trigger: int = 1000, processing_time: str | None = None) -> list[StreamingQuery]:
    """Apply what has arrived in ``changes_path`` since the last call (or go on
    doing so every ``processing_time``).

    Changes may come in any order, in any batch and more than once.  Those that
    can't be applied (unknown operation, no sequence number, a NULL in the key)
    are kept, as they came, under ``<out_root>/rejected``."""
    keys = [key] if isinstance(key, str) else list(key)
    columns = [f.name for f in row_schema.fields]
    changes = (spark.readStream.schema(change_schema(row_schema)).option("maxFilesPerTrigger", max_files_per_trigger)
               .parquet(changes_path))
    applied = newest_changes(changes.where(_valid(keys)).select("op", "seq", *columns), keys)
    writers = [applied.writeStream.outputMode("update").foreachBatch(_publish(out_root, columns))
               .option("checkpointLocation", f"{out_root}/_checkpoint/applied"),
               changes.where(~_valid(keys)).writeStream.format("parquet").option("path", f"{out_root}/rejected")
               .option("checkpointLocation", f"{out_root}/_checkpoint/rejected")]
    queries = [(w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start() for w in writers]
    if not processing_time:
        for q in queries:
            q.awaitTermination()
    return queries


def _complete(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    """Numbers of the folders ``<prefix>=<n>`` whose write has ended."""
    found = [n for n in fs.list_names(spark, folder) if n.startswith(f"{prefix}=")]
    return sorted(int(n.split("=")[1]) for n in found if fs.exists(spark, f"{folder}/{n}/_SUCCESS"))


def published(spark: SparkSession, out_root: str, row_schema: T.StructType, key: str | list[str]) -> DataFrame:
    """The newest published change of each key, tombstones included."""
    schema = published_schema(row_schema)
    bases = _complete(spark, f"{out_root}/base", "upto")
    since = bases[-1] if bases else -1
    later = [b for b in _complete(spark, f"{out_root}/changes", "batch") if b > since]
    rows = spark.createDataFrame([], schema)
    if later:
        rows = (spark.read.schema(schema).option("basePath", f"{out_root}/changes")
                .parquet(*[f"{out_root}/changes/batch={b}" for b in later]))
    if bases:
        base = spark.read.schema(T.StructType(schema.fields[:-1])).parquet(f"{out_root}/base/upto={since}")
        rows = rows.unionByName(base.withColumn("batch", F.lit(since).cast("long")))
    return latest_per_key(rows, key, ["seq", "batch"])


def current_rows(spark: SparkSession, out_root: str, row_schema: T.StructType, key: str | list[str]) -> DataFrame:
    """The table as the changes so far leave it."""
    rows = published(spark, out_root, row_schema, key)
    return rows.where(F.col("op") != "delete").select(*[f.name for f in row_schema.fields])


def rejected(spark: SparkSession, out_root: str, row_schema: T.StructType) -> DataFrame:
    """Changes that couldn't be applied."""
    if not fs.exists(spark, f"{out_root}/rejected/_spark_metadata"):
        return spark.createDataFrame([], change_schema(row_schema))
    return spark.read.schema(change_schema(row_schema)).parquet(f"{out_root}/rejected")


def compact(spark: SparkSession, out_root: str, row_schema: T.StructType, key: str | list[str]) -> int | None:
    """Fold what is published into a new base; returns its last batch.  The old
    base and batches stay until nothing reads them."""
    batches = _complete(spark, f"{out_root}/changes", "batch")
    if not batches:
        return None
    (published(spark, out_root, row_schema, key).drop("batch").where(F.col("op") != "delete")
     .write.mode("overwrite").parquet(f"{out_root}/base/upto={batches[-1]}"))
    return batches[-1]
