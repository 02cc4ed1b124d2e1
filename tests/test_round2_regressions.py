"""Cases in which state was lost or doubled once."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.functions.json import decode_json
from sparkweave.operators import stats
from sparkweave.operators.upsert import latest_per_key, upsert
from sparkweave.sinks import loads
from sparkweave.sinks.documents import DocumentTable
from sparkweave.sources.inventory import listing
from sparkweave.streaming import topics


def test_consume_returns_every_batch(spark, tmp):
    for i in range(6):
        topics.publish(spark.range(i * 100, i * 100 + 100, numPartitions=1).withColumnRenamed("id", "n"), tmp, "/volume/stream:topic")
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        assert topics.consume(spark, tmp, "g/1", max_files_per_trigger=1).count() == 600
        assert topics.consume(spark, tmp, "g/1").count() == 0
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    r = topics.topic_positions(spark, tmp).collect()
    assert [(x.topic, x.published, x.consumed) for x in r] == [("/volume/stream:topic", 600, 600)]


def test_consume_again_after_failure(spark, tmp, monkeypatch):
    topics.publish(spark.range(5), tmp, "t")
    monkeypatch.setattr(fs, "write_text", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        topics.consume(spark, tmp, "g")
    monkeypatch.undo()
    assert topics.topic_positions(spark, tmp).first().consumed == 5
    assert topics.consume(spark, tmp, "g").count() == 5 and topics.consume(spark, tmp, "g").count() == 0


def test_unread_topic_is_at_zero(spark, tmp):
    topics.publish(spark.range(3), tmp, "t")
    assert {r.consumed for r in topics.topic_positions(spark, tmp).collect()} == {0}
    topics.consume(spark, tmp, "fast")
    topics.publish(spark.range(2), tmp, "t")
    topics.consume(spark, tmp, "fast")
    topics.consume(spark, tmp, "slow", "t")
    topics.publish(spark.range(1), tmp, "t")
    r = topics.topic_positions(spark, tmp).first()
    assert (r.published, r.consumed) == (6, 5)


def test_null_order_keeps_the_row(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (2, "c", 5), (3, "d", None), (3, "e", None)], "k int, v string, o int")
    rows = {r.k: r.v for r in latest_per_key(df, "k", "o").collect()}
    assert rows[1] == "a" and rows[2] == "c" and rows[3] in ("d", "e") and set(rows) == {1, 2, 3}
    with pytest.raises(ValueError):
        upsert(df, df, "k")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_bounds_do_not_depend_on_the_drivers_zone(spark, kind):
    base = dt.datetime(2024, 1, 2, 12)
    df = (spark.createDataFrame([((base - dt.timedelta(hours=h)).isoformat(sep=" "),) for h in range(12)], "t string")
          .select(F.col("t").cast(kind).alias("ts"), F.lit(1.0).alias("v")))
    old = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        assert stats.retention(df, "ts", 3 * 3600).count() == 4
        assert stats.downsample(df, "ts", "v", "1 hour", "none", start="3h-ago").count() == 4
        assert stats.retention(df, "ts", 3600, now=base).count() == 2
    finally:
        os.environ.pop("TZ") if old is None else os.environ.__setitem__("TZ", old)
        time.tzset()
    assert stats.retention(df.where("false"), "ts", 60).count() == 0


def test_json_with_more_behind_it(spark):
    raw = ['{"k":1}', ' {"k": 2} ', '{"k":1} trailing', '{"k":1}{"k":2}', '{"k":1},{"k":2}', '{"k":1},"x":2', '{"k":1}]', '{"k":1}}',
           "", None, "null", "[]", '{"k":"x"}', "{}", '{"k":1}] x}']
    df = spark.createDataFrame(list(enumerate(raw)), "i int, m string")
    good, bad = decode_json(df, "m", T.StructType([T.StructField("k", T.IntegerType())]), keep=["i"])
    assert {r.i: r.k for r in good.collect()} == {0: 1, 1: 2, 13: None}
    assert {r.i: r.raw for r in bad.collect()} == {i: x for i, x in enumerate(raw) if i not in (0, 1, 13)}


def test_plain_insert(spark, tmp):
    t = DocumentTable(spark, tmp, key="k")
    t.insert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    for rows in ([(2, "c")], [(3, "c"), (3, "d")], [(None, "c")]):
        with pytest.raises(ValueError):
            t.insert(spark.createDataFrame(rows, "k int, v string"))
    assert loads.read_loads(spark, t.data).count() == 2
    t.insert(spark.createDataFrame([(5, "e")], "k int, v string"), load=5)
    t.insert(spark.createDataFrame([(5, "e")], "k int, v string"), load=5)  # a replay
    assert loads.read_loads(spark, t.data).count() == 3


def test_listing_allow_list(spark):
    inv = spark.createDataFrame([("a/b", 1, dt.datetime(2024, 1, 1))], "path string, length long, modified timestamp")
    assert listing(inv, "a", allowed=["a"]).count() == 1
    with pytest.raises(PermissionError):
        listing(inv, "ab", allowed=["a"])
