"""Topics (SRC-6, SRC-7, SNK-6, STR-1, FLT-7, AGG-5).

Messages are rows ``(key, value, topic, timestamp)``.  On a broker they go
through Spark's Kafka source and sink.  Without one, publishing appends them to
a folder, by topic, and consuming is Spark's file stream over it with
``trigger(availableNow=True)`` and one checkpoint for each group and
subscription: a group sees every message once, a new group starts from the
earliest.  What a batch delivers is written under its number, so a batch that is
run again replaces its own output; ``consume`` returns what is above the number
that was returned before.

Positions and statistics are plain aggregates over the messages and over what
was delivered.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.functions.json import decode_json, encode_json

MESSAGE = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("topic", T.StringType())])
DELIVERED = "group string, sub string, batch_id int, topic string, messages long"
ALL = "_all"


def message(df: DataFrame, topic: str | Column, key: Column | str | None = None, value: Column | None = None,
            timestamp: Column | None = None) -> DataFrame:
    """Every row of ``df`` as one message; ``topic`` is a name or a Column, the
    value defaults to the row as JSON."""
    k = F.col(key) if isinstance(key, str) else key
    t = F.lit(topic) if isinstance(topic, str) else topic
    v = value if value is not None else encode_json(*[F.col(c) for c in df.columns])
    at = timestamp if timestamp is not None else F.current_timestamp()
    return df.select((k.cast("string") if k is not None else F.lit(None)).cast("binary").alias("key"), v.cast("binary").alias("value"),
                     at.cast("timestamp").alias("timestamp"), t.cast("string").alias("topic"))


def publish(df: DataFrame, root: str, topic: str | Column, key: Column | str | None = None, value: Column | None = None,
            timestamp: Column | None = None) -> None:
    """Append the rows of ``df`` as messages (one write, all or nothing)."""
    message(df, topic, key, value, timestamp).write.mode("append").partitionBy("topic").parquet(f"{root}/messages")


def messages(spark: SparkSession, root: str, topic: str | None = None) -> DataFrame:
    """All messages ever published (a batch view)."""
    if not fs.exists(spark, f"{root}/messages"):
        return spark.createDataFrame([], MESSAGE)
    df = spark.read.schema(MESSAGE).parquet(f"{root}/messages")
    return df.where(F.col("topic") == topic) if topic else df


def consume(spark: SparkSession, root: str, group: str, topic: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Messages that ``group`` hasn't been given yet (a bounded run); none when it
    is up to date.  A failure on the way returns them again next time."""
    base = f"group={quote(group, safe='')}/sub={quote(topic or ALL, safe='')}"
    delivered = f"{root}/delivered/{base}"
    fs.mkdirs(spark, f"{root}/messages")
    reader = spark.readStream.schema(MESSAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(f"{root}/messages")
    if topic:
        stream = stream.where(F.col("topic") == topic)  # other topics' files are listed, never read
    q = (stream.writeStream.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{delivered}/batch_id={i}"))
         .option("checkpointLocation", f"{root}/checkpoints/{base}").trigger(availableNow=True).start())
    q.awaitTermination()
    returned = f"{root}/returned/{base}"
    last = int(fs.read_text(spark, returned) or -1)
    ids = sorted(i for n in fs.list_names(spark, delivered) if (i := int(n.split("=")[1])) > last)
    if not ids:
        return spark.createDataFrame([], MESSAGE)
    found = spark.read.schema(MESSAGE).parquet(*[f"{delivered}/batch_id={i}" for i in ids])
    fs.write_text(spark, returned, str(ids[-1]), overwrite=True)
    return found


def deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Messages delivered, by group, subscription, batch and topic."""
    if not fs.exists(spark, f"{root}/delivered"):
        return spark.createDataFrame([], DELIVERED)
    schema = T.StructType([*MESSAGE.fields, T.StructField("group", T.StringType()), T.StructField("sub", T.StringType()),
                           T.StructField("batch_id", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{root}/delivered")
    return rows.groupBy("group", "sub", "batch_id", "topic").agg(F.count("*").alias("messages"))


def topic_positions(spark: SparkSession, root: str) -> DataFrame:
    """Per topic: ``size_kb`` (bytes / 1000), ``published`` messages and
    ``consumed``, the position of the slowest group that reads it (0 without)."""
    stats = messages(spark, root).groupBy("topic").agg(
        (F.coalesce(F.sum(F.octet_length("value")), F.lit(0)) / F.lit(1000.0)).alias("size_kb"), F.count("*").alias("published"))
    read = (deliveries(spark, root).groupBy("topic", "group", "sub").agg(F.sum("messages").alias("n"))
            .groupBy("topic").agg(F.min("n").alias("consumed")))
    return stats.join(read, "topic", "left").withColumn("consumed", F.coalesce("consumed", F.lit(0).cast("long")))


def decode_messages(rows: DataFrame, schema: T.StructType, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JSON message values -> (rows, quarantine)."""
    return decode_json(rows, "value", schema, keep=keep)


# ---- Kafka (only when the connector is on the classpath) ---------------------

def kafka_available(spark: SparkSession) -> bool:
    """Whether a stream of the connector's format can be described."""
    try:
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", "-").option("subscribe", "-").load()
        return True
    except Exception:  # noqa: BLE001 (whatever the missing connector raises)
        return False


def kafka_produce(df: DataFrame, servers: str, topic: str, key: Column | None = None) -> None:
    (message(df, topic, key).select("key", "value").write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def kafka_consume(spark: SparkSession, servers: str, topic: str, group: str, checkpoint: str, sink: str) -> None:
    (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
          .option("subscribe", topic).option("startingOffsets", "earliest")
          .option("kafka.group.id", group).load()
          .writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
          .format("parquet").start(sink).awaitTermination())
