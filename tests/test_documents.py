import pytest
from pyspark.sql import functions as F

from sparkweave.operators.documents import compile_where, find_by_id, peek, search, search_terms, table_query


@pytest.fixture()
def people(spark):
    return spark.createDataFrame(
        [("1", "ann", 30, None), ("2", "bob", 40, "x"), ("3", "cy", None, "y"), ("4", "dee", 25, "x")],
        "_id string, name string, age int, tag string")


@pytest.mark.parametrize("cond,ids", [
    ({"$eq": {"name": "bob"}}, {"2"}),
    ({"$ne": {"tag": "x"}}, {"3"}),
    ({"$lt": {"age": 30}}, {"4"}), ({"$le": {"age": 30}}, {"1", "4"}),
    ({"$gt": {"age": 30}}, {"2"}), ({"$ge": {"age": 30}}, {"1", "2"}),
    ({"$in": {"_id": ["1", "3"]}}, {"1", "3"}), ({"$nin": {"_id": ["1", "3"]}}, {"2", "4"}),
    ({"$like": {"name": "%e%"}}, {"4"}),
    ({"$exists": "tag"}, {"2", "3", "4"}), ({"$notexists": "age"}, {"3"}),
    ({"$and": [{"tag": "x"}, {"$gt": {"age": 30}}]}, {"2"}),
    ({"$or": [{"name": "ann"}, {"name": "cy"}]}, {"1", "3"}),
    ({"$not": {"tag": "x"}}, {"3"}),
    ({"tag": "x", "age": 25}, {"4"}),
    ({}, {"1", "2", "3", "4"}),
])
def test_compile_where(people, cond, ids):
    assert {r["_id"] for r in people.where(compile_where(cond)).collect()} == ids


def test_unknown_operator(people):
    with pytest.raises(ValueError):
        compile_where({"$regex": {"name": "a"}})


def test_find_and_search(people):
    assert find_by_id(people, "2").first()["name"] == "bob"
    assert find_by_id(people, "99").count() == 0
    out = search(people, ["_id"], {"$eq": {"tag": "x"}})
    assert out.columns == ["_id"] and out.count() == 2


def test_peek(people):
    assert peek(people, None).count() == 4
    assert [r["_id"] for r in peek(people, 2, order_by=["_id"]).collect()] == ["1", "2"]


def test_table_query_sql_nulls(people):
    # SQL semantics: NULL tag is not "!= 'x'"
    assert table_query(people, "tag != 'x'").count() == 1
    assert table_query(people, "").count() == 4


def test_search_terms_whole_text(spark):
    long_text = ("word " * 50_000) + "Tsunami"
    df = spark.createDataFrame([(1, long_text, "en"), (2, "oil and FLOOD", "fr")], "id int, text string, lang string")
    got = {(r["id"], r["term"]) for r in search_terms(df, ["tsunami", "flood", "oil"], keep=["id"]).collect()}
    assert got == {(1, "tsunami"), (2, "flood"), (2, "oil")}
    en = search_terms(df, ["tsunami", "oil"], keep=["id"], where={"lang": "en"})
    assert {r["id"] for r in en.collect()} == {1}


def test_filter_pushdown(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = find_by_id(o, 42, "o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,42)]" in plan
    _ = F
