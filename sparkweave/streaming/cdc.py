"""Change-data-capture landing (SRC-14, SNK-18, FLT-8, STR-5).

A change log is a folder of files with ``op, seq, ts`` plus the row image.
``land_changes`` streams it (checkpointed, ``availableNow`` or a processing
trigger) and, per micro-batch, writes the INSERT row images to Parquet and
to JSON, optionally appends them to a table of loads, and records how many
changes of other kinds were ignored.  Every output is keyed by batch id and
overwritten on replay, so a retried batch adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.json import JSON_OPTIONS
from sparkweave.sinks.loads import append_load

ENVELOPE = [T.StructField("op", T.StringType()), T.StructField("seq", T.LongType()),
            T.StructField("ts", T.TimestampType())]


def change_schema(row_schema: T.StructType) -> T.StructType:
    return T.StructType(ENVELOPE + list(row_schema.fields))


def land_batch(batch: DataFrame, batch_id: int, out_root: str, row_cols: list[str],
               table: str | None = None) -> None:
    landed = f"{out_root}/parquet/batch={batch_id}"
    batch.where(F.col("op") == "insert").select(*row_cols).write.mode("overwrite").parquet(landed)
    spark = batch.sparkSession
    inserts = spark.read.schema(batch.select(*row_cols).schema).parquet(landed)  # read once more, not held in memory
    inserts.write.mode("overwrite").options(**JSON_OPTIONS).json(f"{out_root}/json/batch={batch_id}")
    (batch.where(F.col("op") != "insert").groupBy("op").agg(F.count(F.lit(1)).alias("n"))
          .write.mode("overwrite").parquet(f"{out_root}/ignored/batch={batch_id}"))
    if table is not None and not inserts.isEmpty():
        append_load(inserts, table, batch_id)


def land_changes(spark: SparkSession, changes_path: str, row_schema: T.StructType, out_root: str,
                 table: str | None = None, max_files_per_trigger: int = 1000,
                 processing_time: str | None = None):
    """Start the landing stream; with no ``processing_time`` it processes what
    is there (availableNow) and returns when done.  A micro-batch takes at most
    ``max_files_per_trigger`` files, also when the history is long."""
    reader = spark.readStream.schema(change_schema(row_schema)).option("maxFilesPerTrigger", max_files_per_trigger)
    row_cols = [f.name for f in row_schema.fields]
    w = (reader.parquet(changes_path).writeStream
         .foreachBatch(lambda b, i: land_batch(b, i, out_root, row_cols, table))
         .option("checkpointLocation", f"{out_root}/_checkpoint"))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    if not processing_time:
        q.awaitTermination()
    return q


def read_landed(spark: SparkSession, out_root: str, row_schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Landed rows without the ``batch`` folder column."""
    path = f"{out_root}/{fmt}"
    r = spark.read.schema(T.StructType(list(row_schema.fields) + [T.StructField("batch", T.LongType())]))
    df = r.options(**JSON_OPTIONS).json(path) if fmt == "json" else r.parquet(path)
    return df.drop("batch")
