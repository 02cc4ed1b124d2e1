import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkweave.operators import stats


def test_profile_and_value_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("c",), ("c",), ("c",)], "sex string")
    p = stats.profile(df).first()
    assert (p["n_rows"], p["n_cols"], p["cols"]) == (7, 1, "sex")
    vc = [(r["sex"], r["count"]) for r in stats.value_counts(df, "sex").collect()]
    assert vc == [("c", 3), ("a", 2), ("b", 1)]


@pytest.mark.parametrize("nbytes", [0, 1, 5_242_880, 1_048_576 * 3 + 5243, 123_456_789, 10_485, 173_015, 7_340_032])
def test_format_size_matches_python(spark, nbytes):
    got = spark.range(1).select(stats.format_size(F.lit(nbytes)).alias("s")).first()["s"]
    assert got == f"{nbytes / (1024 ** 2):.2f} MB"


def test_folder_summary_prefix_gets_slash(spark):
    inv = spark.createDataFrame([("users/a.parquet", 10), ("users/b/c.json", 0), ("users.csv", 99), (".hidden", 1)],
                                "path string, length bigint")
    r = stats.folder_summary(inv, "users").first()
    assert (r["folder"], r["objects"], r["total_bytes"]) == ("users/", 2, 10)
    empty = stats.folder_summary(inv, "nothing/").first()
    assert (empty["objects"], empty["total_bytes"], empty["total_size"]) == (0, 0, "0.00 MB")


def test_topic_stats_with_commits(spark):
    log = spark.createDataFrame([("t", 0, 0, "ab"), ("t", 0, 1, "abc"), ("t", 1, 0, "a")],
                                "topic string, partition int, offset bigint, value string")
    commits = spark.createDataFrame([("g1", "t", 0, 1), ("g2", "t", 0, 0), ("g1", "t", 1, 0)],
                                    "group string, topic string, partition int, offset bigint")
    rows = {r["partition"]: r for r in stats.topic_stats(log, commits, partition_col="partition").collect()}
    assert rows[0]["published"] == 2 and rows[0]["consumed"] == 1 and rows[0]["size_kb"] == 0.005
    assert rows[1]["published"] == 1 and rows[1]["consumed"] == 1


def test_retention_and_downsample(spark):
    base = dt.datetime(2024, 1, 2, 12, 0, 0)
    rows = [(base - dt.timedelta(hours=h), float(h)) for h in (0, 1, 2, 23, 25, 48)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    assert stats.retention(df, "ts", 86_400).count() == 4
    assert stats.retention(df, "ts", 3600, now=base).count() == 2
    assert stats.downsample(df, "ts", "v", "1 hour", "none", start="1d-ago").count() == 4
    s = stats.downsample(df, "ts", "v", "1 day", "sum", start="2h-ago").collect()
    assert sum(r["value"] for r in s) == 3.0
    with pytest.raises(ValueError):
        stats.downsample(df, "ts", "v", "1 hour", "median")
    with pytest.raises(ValueError):
        stats.parse_relative("yesterday")
