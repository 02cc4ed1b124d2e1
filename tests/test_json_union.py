from pyspark.sql import types as T

from sparkweave.functions import json_union as ju


def decode(spark, texts, parts=3):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, value string").repartition(parts)
    rows, bad = ju.decode_union(df, "value", keep=["n"])
    return rows, {r.n: r.raw for r in bad.collect()}


def test_types_merge_upwards(spark):
    rows, bad = decode(spark, ['{"a": 1, "b": 1, "c": 1, "d": true, "e": [1], "f": null}', '{"a": 3000000000, "b": 1.5, "c": "x", "d": 1, "e": [2.5], "g": {"x": 1}}',
                               '{"g": {"y": [null, "z"], "x": "t"}, "e": null}'])
    assert bad == {}
    t = {f.name: f.dataType for f in rows.schema.fields}
    assert t["a"] == T.LongType() and t["b"] == T.DoubleType() and t["c"] == t["d"] == t["f"] == T.StringType()
    assert t["e"] == T.ArrayType(T.DoubleType())
    assert {f.name: f.dataType for f in t["g"].fields} == {"x": T.StringType(), "y": T.ArrayType(T.StringType())}
    got = {r.n: r for r in rows.collect()}
    assert (got[0].a, got[0].b, got[0].c, got[0].d, got[0].e, got[0].f, got[0].g) == (1, 1.0, "1", "true", [1.0], None, None)
    assert (got[1].a, got[1].c, got[1].d, got[1].e, got[1].g.x, got[1].g.y) == (3000000000, "x", "1", [2.5], "1", None)
    assert got[2].g.x == "t" and got[2].g.y == [None, "z"] and got[2].a is None


def test_objects_and_scalars_of_one_key_are_text(spark):
    rows, _ = decode(spark, ['{"k": {"x": 1}}', '{"k": [1, 2]}', '{"k": "s"}', "{}"])
    assert {r.n: r.k for r in rows.collect()} == {0: '{"x":1}', 1: "[1,2]", 2: "s", 3: None}


def test_quarantine(spark):
    texts = ['{"a": 1}', "{broken", None, "", "[1]", "3", '"s"', "null", '{"a": 1} {"a": 2}', '{"a": 1, "a": 2}', '{"a": 2}, {"b": 1}']
    rows, bad = decode(spark, texts)
    assert [(r.n, r.a) for r in rows.collect()] == [(0, 1)] and rows.columns == ["n", "a"]
    assert bad == {i: t for i, t in enumerate(texts) if i}


def test_names_that_clash(spark):
    rows, _ = decode(spark, ['{"n": 5, "a.b": 1, "Key": "x", "key": "y", "we`ird <OBJECT<": 2}'])
    assert rows.columns[0] == "n" and len({c.lower() for c in rows.columns}) == len(rows.columns) == 6
    assert sorted(map(str, rows.collect()[0])) == sorted(["0", "5", "1", "x", "y", "2"])


def test_nothing_to_read(spark):
    rows, bad = decode(spark, [])
    assert rows.columns == ["n"] and rows.count() == 0 and bad == {}
    rows, bad = decode(spark, ["{}", "x"])
    assert rows.columns == ["n"] and [r.n for r in rows.collect()] == [0] and bad == {1: "x"}


def test_one_pass_finds_keys_of_the_last_message(spark):
    texts = ['{"a": 1}'] * 5000 + ['{"rare": {"deep": 1.5}}']
    assert ju.union_schema(spark.createDataFrame([(t,) for t in texts], "v string").repartition(8), "v").simpleString() == "struct<a:bigint,rare:struct<deep:double>>"
