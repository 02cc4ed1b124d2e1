"""Every registered query against its DuckDB oracle on the smallest tables."""

import hashlib
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from sparkweave.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() else f"{v:.9g}"
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v.tolist() if hasattr(v, "tolist") else v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


#: The feature of this query is a label function of the user's.
USERS_UDF = {"label_udf"}


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
    assert catalog.QUERIES.items() <= E.queries().items() and catalog.ORACLE.items() <= E.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = df.toPandas()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and ("ArrowEvalPython" not in plan or name in USERS_UDF)   # no Python UDF of ours in the query
    want = duck.sql(E.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _digest(got) == _digest(want)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["c_name", "c_nationkey", "c_mktsegment", "category_type"]
    assert df.count() > 0
