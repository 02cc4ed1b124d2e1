import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from sparkweave import fs
from sparkweave.operators.asof import asof_join, lag_series
from sparkweave.sinks.json_array import read_json_array, write_json_array
from sparkweave.streaming import metrics

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("every", ["1 minute", "1 hour", "100 days"])
def test_asof_equals_definition(spark, every):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot"]), at(rng.choice([None, *range(0, 600, 7)])), i) for i in range(150)]
    rows += [rows[5]] * 3
    facts = [(rng.choice(["a", "hot", "hot", None]), at(rng.choice([None, *range(30, 500)])), rng.randrange(100), rng.choice([None, "x"])) for _ in range(120)]
    got = asof_join(spark.createDataFrame(rows, "k string, t timestamp_ntz, v int").repartition(4),
                    spark.createDataFrame(facts, "k string, ft timestamp_ntz, n int, s string").repartition(3), ["k"], "t", "ft", ["n", "s"], every)
    assert got.columns == ["k", "t", "v", "n", "s"]

    def latest(k, t):
        found = [(ft, n, s or "") for fk, ft, n, s in facts if t and ft and fk == k and ft <= t]
        return max(found)[1:] if found else (None, "")

    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:4] + (r.s or "",) for r in got.collect()), key=key) == sorted(((k, t, v, *latest(k, t)) for k, t, v in rows), key=key)


def test_asof_plan_has_no_range_or_cross_join(spark):
    a = spark.createDataFrame([("a", T0)], "k string, t timestamp_ntz")
    b = spark.createDataFrame([("a", T0, 1)], "k string, ft timestamp_ntz, n int")
    plan = asof_join(a, b, ["k"], "t", "ft", ["n"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert asof_join(a.limit(0), b, ["k"], "t", "ft", ["n"]).count() == 0
    assert asof_join(a, b.limit(0), ["k"], "t", "ft", ["n"]).first().n is None


def test_lag_series(spark):
    log = spark.createDataFrame([("t", at(i), i) for i in range(10)], "topic string, at timestamp_ntz, offset long")
    commits = spark.createDataFrame([("t", at(4), 3), ("t", at(8), 7)], "topic string, at timestamp_ntz, offset long")
    polls = spark.createDataFrame([("t", at(x)) for x in (-1, 0, 4, 6, 60 * 48)] + [("u", at(3))], "topic string, at timestamp_ntz")
    got = {(r.topic, r.at): (r.published, r.consumed, r.lag) for r in lag_series(polls, log, commits).collect()}
    assert got == {("t", at(-1)): (0, 0, 0), ("t", at(0)): (1, 0, 1), ("t", at(4)): (5, 3, 2), ("t", at(6)): (7, 3, 4), ("t", at(60 * 48)): (10, 7, 3), ("u", at(3)): (0, 0, 0)}


def test_metrics_close_expire_and_count_late_rows(spark, tmp):
    schema = spark.createDataFrame([], "ts timestamp_ntz, kind string, value double").schema
    inbox, out = f"{tmp}/in", f"{tmp}/out"
    aggs = {"n": F.count("*"), "total": F.sum("value")}

    def deliver(*points):
        spark.createDataFrame([(at(m), k, float(v)) for m, k, v in points], schema).coalesce(1).write.mode("append").parquet(inbox)
        metrics.run_metrics(spark, inbox, schema, out, aggs, every="10 minutes", delay="5 minutes", group_cols=["kind"])
        shape = metrics.windowed(spark.createDataFrame([], schema), "ts", "10 minutes", "5 minutes", ["kind"], aggs).schema
        found = [(int((r.bucket - T0).total_seconds() // 60), r.kind, r.n, r.total) for r in metrics.closed_windows(spark, out, shape).collect()]
        assert len(found) == len(set(found))
        return set(found)

    assert deliver((1, "a", 1), (9, "a", 2), (3, None, 5)) == set()
    first = deliver((12, "a", 4), (8, "a", 8), (31, "a", 1))  # 8 is out of order, not late
    assert first == {(0, "a", 3, 11.0), (0, None, 1, 5.0), (10, "a", 1, 4.0)}
    again = deliver((2, "a", 100), (11, "a", 100), (33, "a", 1), (300, "a", 1))  # two are late
    assert again == first | {(30, "a", 2, 2.0)}
    p = metrics.progress(spark, out).collect()
    assert sum(r.late_rows for r in p) == 2 and max(r.state_rows for r in p) <= 4


@pytest.mark.parametrize("empty_at", [(), (0,), (2,), (4,), (0, 1, 2, 4), (0, 1, 2, 3, 4)])
def test_parts_are_one_array(spark, tmp, empty_at):
    rows = [(p, i, f'q"uo\nte ] [ , {i}', None if i % 2 else [i]) for p in range(5) if p not in empty_at for i in range(3)]
    df = spark.createDataFrame(rows, "p int, i int, `a.b` string, xs array<int>").repartitionByRange(5, "p")
    assert len(rows) == df.count()
    write_json_array(df, tmp)
    text = "".join("\n".join(r.value for r in spark.read.text(f"{tmp}/{n}").collect()) for n in sorted(fs.list_names(spark, tmp)) if n.startswith("part-"))
    assert sorted((r["p"], r["i"], r["a.b"], r.get("xs")) for r in json.loads(text)) == sorted(rows)
    assert sorted(map(tuple, read_json_array(spark, tmp, df.schema).collect()), key=str) == sorted(rows, key=str)
