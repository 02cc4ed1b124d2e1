import datetime as dt

from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.streaming import cdc_apply as ca

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("note", T.StringType())])
LOG = "op string, seq bigint, ts timestamp, id bigint, name string, note string"
AT = dt.datetime(2024, 1, 1)


class Feed:
    def __init__(self, spark, root):
        self.spark, self.inbox, self.out = spark, f"{root}/in", f"{root}/out"

    def deliver(self, *changes):
        rows = [(op, seq, AT, i, name, None) for op, seq, i, name in changes]
        self.spark.createDataFrame(rows, LOG).write.mode("append").parquet(self.inbox)
        ca.apply_changes(self.spark, self.inbox, ROW, "id", self.out)

    def table(self):
        return {r.id: r.name for r in ca.current_rows(self.spark, self.out, ROW, "id").collect()}

    def state_rows(self):
        return ca.published(self.spark, self.out, ROW, "id").count()


def test_out_of_order_tombstones_and_replay(spark, tmp):
    feed = Feed(spark, tmp)
    assert feed.table() == {}
    feed.deliver(("delete", 5, 1, None), ("insert", 1, 2, "two"), ("update", 3, 2, "zwei"))
    assert feed.table() == {2: "zwei"}
    feed.deliver(("insert", 1, 1, "one"), ("update", 2, 2, "deux"))  # older than what is known: nothing comes back
    assert feed.table() == {2: "zwei"}
    feed.deliver(("insert", 7, 1, "again"), ("delete", 9, 2, None))
    assert feed.table() == {1: "again"}
    feed.deliver(("insert", 7, 1, "again"), ("delete", 9, 2, None))  # delivered twice
    assert feed.table() == {1: "again"} and feed.state_rows() == 2
    commits = f"{feed.out}/_checkpoint/applied/commits"
    last = max(int(n) for n in fs.list_names(spark, commits) if n.isdigit())
    fs.delete(spark, f"{commits}/{last}")  # a failure after the batch was written: it runs again under its number
    feed.deliver(("update", 8, 1, "later"))
    assert feed.table() == {1: "later"}


def test_compaction_keeps_the_table(spark, tmp):
    feed = Feed(spark, tmp)
    assert ca.compact(spark, feed.out, ROW, "id") is None
    feed.deliver(("insert", 1, 1, "a"), ("insert", 2, 2, "b"), ("insert", 3, 3, "c"))
    feed.deliver(("delete", 4, 3, None))
    before = feed.table()
    ca.compact(spark, feed.out, ROW, "id")
    assert feed.table() == before == {1: "a", 2: "b"} and feed.state_rows() == 2
    feed.deliver(("update", 2, 3, "c2"), ("update", 5, 1, "a2"))  # the first is older than the delete that was folded
    assert feed.table() == {1: "a2", 2: "b"}


def test_rejected_changes_are_kept(spark, tmp):
    feed = Feed(spark, tmp)
    assert ca.rejected(spark, feed.out, ROW).count() == 0
    feed.deliver(("insert", 1, None, "no key"), ("truncate", 2, 1, "no such"), (None, 3, 1, "none"), ("insert", None, 1, "no number"), ("insert", 4, 1, "ok"))
    assert feed.table() == {1: "ok"}
    assert sorted(r.name for r in ca.rejected(spark, feed.out, ROW).collect()) == ["no key", "no number", "no such", "none"]


def test_same_number_is_decided_alike_in_any_order(spark, tmp):
    one, two = Feed(spark, f"{tmp}/1"), Feed(spark, f"{tmp}/2")
    a, b = ("update", 5, 1, "x"), ("update", 5, 1, "y")
    one.deliver(a, b)
    two.deliver(b)
    two.deliver(a)
    assert one.table() == two.table()


def test_composite_key(spark, tmp):
    inbox = f"{tmp}/in"
    rows = [("insert", 1, AT, 1, "a", "p"), ("insert", 2, AT, 1, "b", "q"), ("delete", 3, AT, 1, "a", None)]
    spark.createDataFrame(rows, LOG).write.parquet(inbox)
    ca.apply_changes(spark, inbox, ROW, ["id", "name"], f"{tmp}/out")
    assert [tuple(r) for r in ca.current_rows(spark, f"{tmp}/out", ROW, ["id", "name"]).collect()] == [(1, "b", "q")]
