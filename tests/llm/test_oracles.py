import duckdb
import pytest

from sparkweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(rows)
