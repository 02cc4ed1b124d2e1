import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.sinks import loads


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _df(spark, rows, schema="k int, v string"):
    return spark.createDataFrame(rows, schema)


def test_appends_and_replayed_loads(spark, tmp):
    schema = _df(spark, []).schema
    assert loads.read_loads(spark, tmp, schema=schema).count() == 0 and loads.next_load(spark, tmp) == 0
    with pytest.raises(FileNotFoundError):
        loads.read_loads(spark, tmp)
    assert loads.append_load(_df(spark, [(1, "a")]), tmp) == 0
    assert loads.append_load(_df(spark, [(2, "b")]), tmp) == 1
    loads.append_load(_df(spark, [(3, "c")]), tmp, 7)
    loads.append_load(_df(spark, [(3, "c")]), tmp, 7)  # the same batch again
    assert _rows(loads.read_loads(spark, tmp)) == [(1, "a"), (2, "b"), (3, "c")] and loads.loads(spark, tmp) == [0, 1, 7]
    fs.mkdirs(spark, f"{tmp}/load=9")  # a write that never ended
    assert loads.read_loads(spark, tmp).count() == 3 and loads.next_load(spark, tmp) == 8


def test_wider_types_and_new_columns(spark, tmp):
    loads.append_load(_df(spark, [(1, 1.5, [1], (1, "x"), dt.date(2024, 1, 2))], "a int, f float, xs array<int>, s struct<p: int, q: string>, d date"), tmp)
    loads.append_load(_df(spark, [(5_000_000_000, 2.25, [6_000_000_000], (7_000_000_000, 1.0), dt.datetime(2024, 1, 2, 3), "n")],
                          "a long, f double, xs array<long>, s struct<p: long, r: double>, d timestamp_ntz, new string"), tmp)
    df = loads.read_loads(spark, tmp)
    assert df.schema.simpleString() == ("struct<a:bigint,f:double,xs:array<bigint>,s:struct<p:bigint,q:string,r:double>,d:timestamp_ntz,new:string>")
    got = {r.a: r for r in df.collect()}
    assert got[1].f == 1.5 and got[1].xs == [1] and got[1].new is None and got[1].d == dt.datetime(2024, 1, 2)
    assert got[5_000_000_000].xs == [6_000_000_000] and got[5_000_000_000].new == "n"
    assert tuple(got[1].s) == (1, "x", None) and tuple(got[5_000_000_000].s) == (7_000_000_000, None, 1.0)


@pytest.mark.parametrize(("a", "b", "wide"), [
    ("tinyint", "bigint", "bigint"), ("int", "smallint", "int"), ("int", "double", "double"), ("float", "double", "double"), ("decimal(5,2)", "decimal(7,1)", "decimal(8,2)"),
    ("date", "timestamp_ntz", "timestamp_ntz"), ("void", "string", "string"), ("map<string,int>", "map<string,bigint>", "map<string,bigint>"),
    ("bigint", "double", None), ("int", "string", None), ("boolean", "int", None), ("decimal(38,0)", "decimal(38,10)", None), ("array<int>", "int", None)])
def test_common_types(spark, a, b, wide):
    x, y = (T._parse_datatype_string(f"c {t}").fields[0].dataType for t in (a, b))
    for p, q in ((x, y), (y, x)):
        if wide is None:
            with pytest.raises(ValueError):
                loads.wider_type(p, q, "c")
        else:
            assert loads.wider_type(p, q).simpleString() == wide


def test_a_type_that_does_not_merge_is_refused_before_writing(spark, tmp):
    loads.append_load(_df(spark, [(1, "a")]), tmp)
    with pytest.raises(ValueError, match="'k'"):
        loads.append_load(_df(spark, [("x", "a")], "k string, v string"), tmp)
    assert loads.loads(spark, tmp) == [0]


def test_keyed_loads_replace_whole_rows(spark, tmp):
    loads.upsert_load(_df(spark, [(1, "a"), (2, "b")]), tmp, "k")
    loads.upsert_load(spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "c", 1)], "k int, w string, seq int"), tmp, "k", order="seq")
    got = {r.k: r for r in loads.read_latest(spark, tmp, "k").collect()}
    assert set(got) == {1, 2, 3} and got[2].w == "y" and got[2].v is None and got[1].v == "a"
    for rows in ([(4, "a"), (4, "b")], [(None, "a")]):
        with pytest.raises(ValueError):
            loads.upsert_load(_df(spark, rows), tmp, "k")
    assert loads.lookup(spark, tmp, "k", 2).first().w == "y" and loads.lookup(spark, tmp, "k", 9).count() == 0
    plan = loads.read_latest(spark, tmp, "k")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan  # rows of a key are combined before the shuffle


def test_lookup_is_pushed_into_the_scans(spark, tmp):
    loads.upsert_load(spark.range(100).selectExpr("id AS k", "id * 2 AS v"), tmp, "k")
    found = loads.lookup(spark, tmp, "k", 7)
    assert [r.v for r in found.collect()] == [14] and "EqualTo(k,7)" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", [None, "k"])
def test_compaction(spark, tmp, key):
    assert loads.compact(spark, tmp, key) is None
    for i in range(3):
        loads.append_load(_df(spark, [(i, f"v{i}"), (9, f"w{i}")]), tmp)
    read = (lambda: loads.read_latest(spark, tmp, "k")) if key else (lambda: loads.read_loads(spark, tmp))
    before = _rows(read())
    assert loads.compact(spark, tmp, key) == 2 and _rows(read()) == before and loads.compact(spark, tmp, key) is None
    assert loads.append_load(_df(spark, [(9, "last")]), tmp) == 3
    assert (9, "last") in _rows(read()) and len(_rows(read())) == len(before) + (0 if key else 1)


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_text_formats_keep_values(spark, tmp, fmt):
    schema = "id int, addr string, x double, at timestamp_ntz"
    at = dt.datetime(2024, 1, 1, 1, 2, 3, 456789)
    first, second = (1, 'a\nb, "q"', 1.5, at), (2, None, None, at + dt.timedelta(microseconds=1))
    loads.append_load(_df(spark, [first], schema), tmp, fmt=fmt)
    loads.append_load(_df(spark, [second], schema), tmp, fmt=fmt)
    assert _rows(loads.read_loads(spark, tmp, fmt, T._parse_datatype_string(schema))) == [first, second]


def test_hot_key_in_many_loads(spark, tmp):
    for i in range(3):
        loads.append_load(spark.range(0, 3000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.lit(i).alias("v")), tmp)
    got = loads.read_latest(spark, tmp, "k")
    assert got.count() == 2001 and got.where("k = 0").first().v == 2
