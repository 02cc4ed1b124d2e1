import datetime as dt

import pytest

from sparkweave.operators.stats import metric_snapshot
from sparkweave.sinks.documents import DocumentTable
from sparkweave.sources.inventory import list_tables, listing

SCHEMA = "_id string, name string, creditcard string, ssn string"


def test_document_table(spark, tmp):
    t = DocumentTable(spark, f"{tmp}/users")
    from pyspark.sql import types as T
    t.create(T._parse_datatype_string(SCHEMA))
    t.create(T._parse_datatype_string(SCHEMA))                      # idempotent
    assert t.read().count() == 0 and t.get_masks().count() == 0
    t.add(spark.createDataFrame([("a", "Ann Lee", "4111111111111111", "123-45-6789"),
                                 ("b", "Bob Roe", "5500000000000004", "987-65-4321")], SCHEMA))
    t.set_mask("name", "first2")
    t.set_mask("creditcard", "last4")
    with pytest.raises(ValueError):
        t.set_mask("nope", "first2")
    with pytest.raises(ValueError):
        t.set_mask("ssn", "unknown-mask")
    pub = {r["_id"]: r for r in t.read().collect()}
    assert pub["a"]["name"] == "An*****" and pub["a"]["creditcard"] == "************1111"
    assert pub["a"]["ssn"] == "123-45-6789"
    assert t.read("owner").where("_id = 'a'").first()["name"] == "Ann Lee"
    t.upsert(spark.createDataFrame([("a", "Anna Lee", None, None)], SCHEMA))   # full replace
    assert t.find_by_id("a", "owner").first()["creditcard"] is None
    assert t.find_by_id("zz").count() == 0
    assert t.search(["_id"], {"$like": {"name": "Bo%"}}, "owner").count() == 1
    assert [r["_id"] for r in t.peek(1).collect()] == ["a"]
    later = spark.createDataFrame([("b", "Bo 1", None, None, 1), ("b", "Bo 2", None, None, 2)], SCHEMA + ", _seq int")
    t.add(later)                                                    # duplicate key: the later one wins
    assert t.data.endswith('/data')
    assert t.find_by_id("b", "owner").first()["name"] == "Bo 2"


def test_metric_snapshot(spark):
    raw = spark.createDataFrame([(0, 2048, 9, 4)], "timestamp long, logicalsize long, maxoffset long, "
                                                   "minoffsetacrossconsumers long")
    r = metric_snapshot(raw, 1_700_000_000_000).first()
    assert r["timestamp"] == dt.datetime(2023, 11, 14, 22, 13, 20) and r["size_kb"] == 2.048
    assert r["published"] == 10 and r["consumed"] == 4


def test_listing_and_tables(spark):
    inv = spark.createDataFrame(
        [("users/a.csv", 3, dt.datetime(2024, 3, 5, 14, 7)), ("users/sub/b", 4, dt.datetime(2024, 3, 6, 1, 2)),
         ("top.txt", 1, dt.datetime(2024, 1, 1, 0, 0))], "path string, length bigint, modified timestamp")
    rows = {r["name"]: r for r in listing(inv, "users").collect()}
    assert rows["a.csv"]["mtime"] == "Mar 05 14:07" and not rows["a.csv"]["is_dir"]
    assert rows["sub"]["is_dir"] and rows["sub"]["size"] == 4
    assert {r["name"] for r in listing(inv).collect()} == {"users", "top.txt"}
    assert "name" in list_tables(spark).columns
