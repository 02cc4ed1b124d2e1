"""Registered queries that keep state over time: changes applied by key, live
metrics, consumer lag."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave import fs
from sparkweave.operators.asof import lag_series
from sparkweave.plans.registry import register, table
from sparkweave.session import fresh_path
from sparkweave.streaming.cdc_apply import apply_changes, compact, current_rows
from sparkweave.streaming.metrics import closed_windows, progress, run_metrics, windowed


@register("cdc_apply", """
    with log as (
      select 10 * o_orderkey + 1 as seq, 'insert' as op, * from orders
      union all select 10 * o_orderkey + 2, 'update', * replace ('U' as o_orderstatus, 2 * o_totalprice as o_totalprice) from orders where o_orderkey % 3 = 0
      union all select 10 * o_orderkey + 3, 'delete', * from orders where o_orderkey % 5 = 0
      union all select 10 * o_orderkey + 4, 'insert', * replace ('R' as o_orderstatus) from orders where o_orderkey % 20 = 0)
    select * exclude (seq, op) from (select * from log qualify row_number() over (partition by o_orderkey order by seq desc) = 1)
    where op <> 'delete'""")
def cdc_apply(spark, d):
    """Orders as a log of inserts, updates, deletes and rows that come back, that
    arrives in four deliveries in which a key's changes are out of order; the
    third is delivered twice and the last batch is run again after its commit
    is lost."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")

    def change(kind: int, op: str, when, **new) -> F.Column:
        image = [new[c].alias(c) if c in new else F.col(c) for c in o.columns]
        return F.when(when, F.struct((10 * k + kind).alias("seq"), F.lit(op).alias("op"), F.pmod(7 * k + 3 * kind, F.lit(4)).alias("delivery"), *image))

    kinds = F.array(change(1, "insert", F.lit(True)), change(2, "update", k % 3 == 0, o_orderstatus=F.lit("U"), o_totalprice=2 * F.col("o_totalprice")),
                    change(3, "delete", k % 5 == 0), change(4, "insert", k % 20 == 0, o_orderstatus=F.lit("R")))
    log = (o.select(F.explode(F.filter(kinds, lambda c: c.isNotNull())).alias("c")).select("c.*")
           .withColumn("ts", F.col("o_orderdate").cast("timestamp")))
    inbox, out = fresh_path(spark, "q/changes_in"), fresh_path(spark, "q/changes_out")
    for delivery in (0, 1, 2, 2, 3):
        log.where(F.col("delivery") == delivery).select("op", "seq", "ts", *o.columns).write.mode("append").parquet(inbox)
        apply_changes(spark, inbox, o.schema, "o_orderkey", out)
        if delivery == 1:
            compact(spark, out, o.schema, "o_orderkey")
    commits = f"{out}/_checkpoint/applied/commits"
    fs.delete(spark, f"{commits}/{max(int(n) for n in fs.list_names(spark, commits) if n.isdigit())}")
    apply_changes(spark, inbox, o.schema, "o_orderkey", out)
    return current_rows(spark, out, o.schema, "o_orderkey")


_METRIC_SQL = """
    with bounds as (
      select min(ts) as a, max(ts) - min(ts) as span, max(ts) - interval 10 minutes as mark from events),
    points as (select e.*, least(floor(3 * epoch_us(ts - a)::double / epoch_us(a + span - a)), 2) as part, mark from events e, bounds),
    inside as (select * from points where not (event_id % 97 = 0 and part = 0)),
    closed as (
      select time_bucket(interval '15 minutes', ts) as bucket, event_type, count(*) as n, min(value) as lo, max(value) as hi, any_value(mark) as mark
      from inside group by all)
"""


@register("metric_stream", _METRIC_SQL + """
    select bucket, event_type, n, lo, hi, late_rows from closed, (select count(*) as late_rows from points where event_id % 97 = 0 and part = 0)
    where bucket + interval 15 minutes <= mark""")
def metric_stream(spark, d):
    """Events arrive in time order in three deliveries with a restart after each;
    some of the first third come with the last and are late: they change no
    window and are counted."""
    e = table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = e.agg(F.min(at)).scalar(), e.agg(F.max(at)).scalar()
    part = F.least(F.floor(3 * (at - first).cast("double") / (last - first)), F.lit(2))
    late = (F.col("event_id") % 97 == 0) & (F.col("part") == 0)
    points = e.withColumn("part", part).withColumn("part", F.when(late, 2).otherwise(F.col("part")))
    aggs = {"n": F.count("*"), "lo": F.min("value"), "hi": F.max("value")}
    inbox, out = fresh_path(spark, "q/points_in"), fresh_path(spark, "q/points_out")
    for i in range(3):
        points.where(F.col("part") == i).drop("part").write.mode("append").parquet(inbox)
        run_metrics(spark, inbox, e.schema, out, aggs, group_cols=["event_type"])
    schema = windowed(e, "ts", "15 minutes", "10 minutes", ["event_type"], aggs).schema
    late_rows = progress(spark, out).agg(F.sum("late_rows")).scalar()
    return closed_windows(spark, out, schema).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", "lo", "hi",
                                                     late_rows.alias("late_rows"))


@register("topic_lag_series", """
    with log as (select event_type as topic, ts as at, max(event_id) + 1 as published from events group by all),
    commits as (select event_type as topic, ts + interval 5 minutes as at, max(event_id) + 1 as consumed from events where event_id % 10 = 0 group by all),
    polls as (select distinct event_type as topic, time_bucket(interval '1 hour', ts) as at from events),
    p as (select polls.topic, polls.at, published from polls asof left join log on polls.topic = log.topic and polls.at >= log.at)
    select p.topic, p.at, coalesce(published, 0) as published, coalesce(consumed, 0) as consumed, coalesce(published, 0) - coalesce(consumed, 0) as lag
    from p asof left join commits on p.topic = commits.topic and p.at >= commits.at""")
def topic_lag_series(spark, d):
    """Topic = event type, offset = event id.  A group commits every tenth event
    five minutes after it came; the topics are polled at every full hour that
    follows on events of theirs."""
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), F.col("ts").alias("at"), F.col("event_id").alias("offset"))
    commits = (e.where(F.col("offset") % 10 == 0)
               .select("topic", (F.col("at") + F.expr("interval 5 minutes")).alias("at"), (F.col("offset") + 1).alias("offset")))
    polls = e.select("topic", F.window("at", "1 hour").start.alias("at")).distinct()
    return lag_series(polls, e, commits)
