"""Registered queries on columns, masks and listings: the rules of the column
ETL, its label hook, the mask registry, keys, folders, tables and the timed
monitor."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.masks import MASKS, apply_mask
from sparkweave.functions.text import content_id, new_id
from sparkweave.operators.governance import list_masks
from sparkweave.operators.refine import EtlSpec, eligible, refine
from sparkweave.plans.registry import register, table
from sparkweave.session import fresh_path
from sparkweave.sinks.loads import read_loads
from sparkweave.sources.inventory import list_tables, listing
from sparkweave.streaming.monitor import accumulate


@register("eligible_columns", """
    with filled as (
      select c, n from (select count(c_custkey) as c_custkey, count(c_name) as c_name, count(c_nationkey) as c_nationkey,
        count(c_acctbal) as c_acctbal, count(c_mktsegment) as c_mktsegment from customer)
      unpivot (n for c in (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)))
    select step, c as "column", n as filled from filled, (values ('key'), ('remove'), ('mask'), ('label')) s(step)
    where step = 'key' or c <> 'c_custkey' and (step = 'remove' or c <> 'c_acctbal')""")
def eligible_columns(spark, d):
    """The columns that each step of the ETL offers once the key and a column to
    remove are chosen, with how many rows fill them."""
    c = table(spark, d, "customer")
    offered = eligible(c.columns, key="c_custkey", remove=("c_acctbal",))
    steps = F.explode(F.array(*[F.struct(F.lit(s).alias("step"), F.lit(x).alias("column")) for s, xs in offered.items() for x in xs])).alias("s")
    filled = c.agg(*[F.count(x).alias(x) for x in c.columns])
    counted = filled.select(F.explode(F.array(*[F.struct(F.lit(x).alias("c"), F.col(x).alias("filled")) for x in c.columns])).alias("f")).select("f.*")
    wanted = spark.range(1).select(steps).select("s.*")  # names of columns
    return wanted.join(counted, wanted["column"] == counted["c"]).select("step", "column", "filled")


@register("label_udf", """
    select c_custkey, substr(c_name, 1, 2) || '*****' as c_name, c_nationkey, c_acctbal, c_mktsegment,
      case when length(c_mktsegment) > 9 then 'long' else 'short' end || ' ' || lower(substr(c_mktsegment, 1, 1)) as category_type
    from customer""")
def label_udf(spark, d):
    """The label step with a classifier of the user's (a pandas UDF)."""
    @F.pandas_udf(T.StringType())
    def classify(s: pd.Series) -> pd.Series:
        return s.str.len().gt(9).map({True: "long ", False: "short "}) + s.str[0].str.lower()

    return refine(table(spark, d, "customer"), EtlSpec(key="c_custkey", mask="c_name", label="c_mktsegment", labeler=classify))


@register("mask_registry", """
    with masked as (
      select unnest([
        {'name': 'first2', 'v': substr(c_name, 1, 2) || '*****'},
        {'name': 'last4', 'v': case when length(c_name) <= 4 then repeat('*', length(c_name)) else repeat('*', length(c_name) - 4) || right(c_name, 4) end},
        {'name': 'redact', 'v': repeat('*', length(c_name))}, {'name': 'hash', 'v': sha256(c_name)}, {'name': 'null', 'v': null}]) as m
      from customer)
    select m.name as name, count(distinct m.v) as distinct_values, min(m.v) as least, max(length(m.v)) as longest from masked group by 1""")
def mask_registry(spark, d):
    """Every registered mask with what it leaves of the customers' names."""
    each = [F.struct(F.lit(n).alias("name"), apply_mask(n, F.col("c_name")).alias("v")) for n in MASKS]
    masked = table(spark, d, "customer").select(F.explode(F.array(*each)).alias("m")).select("m.*")
    left = masked.groupBy("name").agg(F.countDistinct("v").alias("distinct_values"), F.min("v").alias("least"), F.max(F.length("v")).cast("long").alias("longest"))
    return list_masks(spark).select("name").join(left, "name")


@register("row_keys", """
    select count(*) as n_rows, count(distinct user_id || '/' || event_type) as contents, count(*) as random_keys, true as well_formed from events""")
def row_keys(spark, d):
    """Random hexadecimal keys differ on all rows, keys by content on different
    contents only."""
    e = table(spark, d, "events").select(new_id().alias("r"), content_id("user_id", "event_type").alias("k"))
    formed = F.col("r").rlike("^[0-9a-f]{32}$") & F.col("k").rlike("^[0-9a-f]{64}$")
    return e.agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("contents"), F.countDistinct("r").alias("random_keys"),
                 F.every(formed).alias("well_formed"))


@register("folder_listing", """
    select o_orderpriority as name, sum(floor(o_totalprice))::bigint as size, max(o_orderdate) as modified, true as is_dir,
      strftime(max(o_orderdate), '%b %d %H:%M') as mtime
    from orders where o_orderstatus = 'F' group by 1
    union all select 'about.txt', 7, timestamp '1995-03-05 14:07:00', false, 'Mar 05 14:07' from region where r_regionkey = 0""")
def folder_listing(spark, d):
    """One folder of an inventory: orders as objects below their status and
    priority, and a file beside the folders."""
    o = table(spark, d, "orders")
    path = F.concat_ws("/", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))
    objects = o.select(path.alias("path"), F.floor("o_totalprice").cast("long").alias("length"), F.col("o_orderdate").alias("modified"))
    file = table(spark, d, "region").where("r_regionkey = 0").select(
        F.lit("F/about.txt").alias("path"), F.lit(7).cast("long").alias("length"), F.lit("1995-03-05 14:07:00").cast("timestamp_ntz").alias("modified"))
    return listing(objects.unionByName(file), "F", allowed=["F", "O"])


@register("table_list", """
    select 'nation' as name, count(*) as n_rows from nation union all select 'region', count(*) from region""")
def table_list(spark, d):
    """The tables of a database, with their rows."""
    database = f"sparkweave_{uuid.uuid4().hex[:12]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, 'q/database')}'")
    rows = None
    for t in ("nation", "region"):
        table(spark, d, t).write.saveAsTable(f"{database}.{t}")
        n = spark.table(f"{database}.{t}").agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("t"), "n_rows")
        rows = n if rows is None else rows.union(n)
    listed = list_tables(spark, database)
    return listed.join(rows, listed["name"] == rows["t"]).select("name", "n_rows")


@register("monitor_trigger", "select * from region union all select * from region")
def monitor_trigger(spark, d):
    """The monitor on a processing-time trigger: snapshots that arrive while it
    runs are appended one after another."""
    r = table(spark, d, "region")
    inbox, series = fresh_path(spark, "q/trigger_in"), fresh_path(spark, "q/trigger_series")
    r.write.mode("append").parquet(inbox)
    q = accumulate(spark.readStream.schema(r.schema).parquet(inbox), series, fresh_path(spark, "q/trigger_ckpt"), processing_time="1 second")
    try:
        q.processAllAvailable()
        r.write.mode("append").parquet(inbox)
        q.processAllAvailable()
    finally:
        q.stop()
    return read_loads(spark, series)
