import json
import os
import re
import uuid

import pytest

from sparkweave.sinks.files import choose_output, put_object, write_any, write_refined
from sparkweave.operators.refine import EtlSpec
from sparkweave.sinks.tables import append_to_table, create_table_if_absent
from sparkweave.sources import jdbc
from sparkweave.sources.files import format_of, read_any
from sparkweave.sources.inventory import read_inventory


def test_format_dispatch():
    assert format_of("/a/b.CSV") == "csv" and format_of("x.json") == "json" and format_of("d/x.parquet") == "parquet"
    with pytest.raises(ValueError):
        format_of("x.xlsx")


def test_json_array_and_ndjson(spark, local_tmp):
    with open(f"{local_tmp}/arr.json", "w") as f:
        json.dump([{"a": 1, "b": "x"}, {"a": 2}], f, indent=2)
    df = read_any(spark, f"{local_tmp}/arr.json", schema="a int, b string", multi_line=True)
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, None)]


def test_csv_multiline_and_nulls(spark, tmp):
    df = spark.createDataFrame([(1, "line1\nline2", ""), (2, 'say "hi"', None)], "id int, addr string, note string")
    write_any(df, tmp, "csv")
    back = read_any(spark, tmp, "csv", df.schema, multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "line1\nline2", ""), (2, 'say "hi"', None)]
    with pytest.raises(ValueError):
        write_any(df, tmp + "x", "xml")


def test_refined_sink_drops_key(spark, tmp):
    df = spark.createDataFrame([(1, "Alice")], "id int, name string")
    write_refined(df, EtlSpec(key="id"), tmp, "parquet")
    assert read_any(spark, tmp, "parquet").columns == ["name"]
    empty = df.limit(0)
    assert choose_output(empty, df) is df and choose_output(df, empty) is df


def test_csv_keeps_white_space_and_splits(spark, tmp):
    rows = [(1, "  lead"), (2, "trail  "), (3, ""), (4, None), (5, "\t"), (6, "a,b"), (7, '"')]
    df = spark.createDataFrame(rows, "id int, v string")
    write_any(df.select("v", "id"), f"{tmp}/a", "csv")
    assert sorted((r.id, r.v) for r in read_any(spark, f"{tmp}/a", "csv", "v string, id int").collect()) == rows
    write_any(spark.range(200_000, numPartitions=1).selectExpr("id", "repeat('x', 40) AS v"), f"{tmp}/b", "csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert read_any(spark, f"{tmp}/b", "csv", "id long, v string").rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_inventory_of_a_folder(spark, local_tmp):
    os.makedirs(f"{local_tmp}/users/sub")
    for rel, data in [("users/a.csv", b"abc"), ("users/.hidden", b"x"), ("users/sub/b", b"1234"), ("users/sub/empty", b""), ("users.csv", b"12345")]:
        with open(f"{local_tmp}/{rel}", "wb") as f:
            f.write(data)
    found = read_inventory(spark, local_tmp)
    assert found.columns == ["path", "length", "modified"]
    assert {r["path"]: r["length"] for r in found.collect()} == {"users/a.csv": 3, "users/sub/b": 4, "users.csv": 5}  # hidden and empty ones are left out
    assert {r["path"] for r in read_inventory(spark, local_tmp, recursive=False).collect()} == {"users.csv"}
    read = re.search("ReadSchema: [^\n]*", found._jdf.queryExecution().executedPlan().toString())
    assert read is None or "content" not in read[0]  # names and sizes only
    with pytest.raises(FileNotFoundError, match="no such folder"):
        read_inventory(spark, f"{local_tmp}/missing").count()


def test_jdbc_identity_roundtrip(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex[:8]};create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.execute(spark, url, "CREATE TABLE users (id INT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, "
                             "fname CLOB, city CLOB)", props)   # Spark's Derby dialect binds strings as CLOB
    df = spark.createDataFrame([("ann", "x"), ("bob", None)], "fname string, city string")
    jdbc.write_table(df, url, "users", props)
    back = jdbc.read_table(spark, url, "users", props, partition_column="id", num_partitions=2)
    rows = sorted((r["ID"], r["FNAME"], r["CITY"]) for r in back.collect())
    assert [r[0] for r in rows] == [1, 2] and {r[1] for r in rows} == {"ann", "bob"}
    pushed = back.where("ID = 2")
    assert "PushedFilters: [*IsNotNull(ID), *EqualTo(ID,2)]" in pushed._jdf.queryExecution().executedPlan().toString()
    assert pushed.count() == 1


def test_catalog_table_append(spark, tmp):
    name = f"sw_t_{uuid.uuid4().hex[:8]}"
    create_table_if_absent(spark, name, "id int, name string", "parquet", location=tmp)
    create_table_if_absent(spark, name, "id int, name string", "parquet", location=tmp)   # no-op
    append_to_table(spark.createDataFrame([("a", 1)], "name string, id int"), name)        # by name
    append_to_table(spark.createDataFrame([(2,)], "id int"), name)                         # missing column NULL
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError):
        append_to_table(spark.createDataFrame([(3, 1)], "id int, nope int"), name)


def test_put_object(spark, tmp):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    p = put_object(df, f"{tmp}/newbucket", "users", "application/octet-stream")
    assert p.endswith("users.parquet") and read_any(spark, p).count() == 1
    p = put_object(df, f"{tmp}/newbucket", "users", "application/json")
    assert read_any(spark, p, schema=df.schema).first()["v"] == "a"
    with pytest.raises(ValueError):
        put_object(df, tmp, "x", "text/html")


def test_merge_into_file_table_swaps_location(spark, tmp):
    from sparkweave.sinks.tables import merge_into_table
    name = f"sw_m_{uuid.uuid4().hex[:8]}"
    create_table_if_absent(spark, name, "_id int, v string", "parquet", location=f"{tmp}/v0")
    append_to_table(spark.createDataFrame([(1, "a"), (2, "b")], "_id int, v string"), name)
    how = merge_into_table(spark.createDataFrame([(2, "B", 1), (2, "BB", 2), (3, "c", 1)], "_id int, v string, s int")
                           .select("_id", "v", "s"), name, "_id", f"{tmp}/v1", order="s")
    assert how == "swap"
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, "BB"), (3, "c")]


def test_merge_into_json_and_partitioned_tables(spark, tmp):
    from sparkweave.sinks.tables import merge_into_table
    new = spark.createDataFrame([(2, "NEW", "q"), (3, "c", None), (4, "d", "o'p")], "_id int, v string, p string")
    name = f"sw_j_{uuid.uuid4().hex[:8]}"
    create_table_if_absent(spark, name, "_id int, v string, p string", "json", location=f"{tmp}/j0")
    append_to_table(spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "_id int, v string, p string"), name)
    assert merge_into_table(new, name, "_id", f"{tmp}/j1") == "swap"
    want = [(1, "a", "x"), (2, "NEW", "q"), (3, "c", None), (4, "d", "o'p")]
    assert sorted(tuple(r) for r in spark.table(name).collect()) == want
    name = f"sw_p_{uuid.uuid4().hex[:8]}"
    old = [(1, "a", "x"), (2, "b", "y"), (5, "e", "z")]
    spark.createDataFrame(old, "_id int, v string, p string").write.partitionBy("p").option("path", f"{tmp}/p0").saveAsTable(name)
    assert merge_into_table(new, name, "_id", f"{tmp}/p1") == "partitions"
    got = sorted((r._id, r.v, r.p) for r in spark.table(name).collect())
    assert got == [(1, "a", "x"), (2, "NEW", "q"), (3, "c", None), (4, "d", "o'p"), (5, "e", "z")]  # y lost its only row
    with pytest.raises(ValueError):
        merge_into_table(new.unionAll(new), name, "_id", f"{tmp}/p2")
