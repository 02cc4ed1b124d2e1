"""Registered queries: one per operator of the survey's inventory.

Every query reads whole given tables (or data Spark derives from them and
lands in the shared folder) and returns a DataFrame.  ``ORACLE`` holds the
equivalent DuckDB SQL over the same tables; the column names match.
Queries that write land their data below ``spark.checkpoint.dir`` in a new
folder per call.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.masks import last4, sha256
from sparkweave.functions.text import clean_newlines, long_words_joined
from sparkweave.operators import documents as docs
from sparkweave.operators import stats
from sparkweave.operators.governance import empty_policy, masked_columns, masked_view, set_mask, tenant_scope
from sparkweave.operators.ids import allocate_ids
from sparkweave.operators.refine import EtlSpec, refine
from sparkweave.plans.lifecycle import ingest_refine_write
from sparkweave.plans.registry import ORACLE, QUERIES, register, table  # noqa: F401 (the registry is this module's, too)
from sparkweave.session import fresh_path
from sparkweave.sinks.documents import DocumentTable
from sparkweave.sinks.files import choose_output, put_object, write_any
from sparkweave.sinks.loads import append_load, next_load, read_latest, read_loads, upsert_load
from sparkweave.sinks.tables import append_to_table, create_table_if_absent, merge_into_table
from sparkweave.sources import jdbc
from sparkweave.sources.files import read_any, read_parquet
from sparkweave.sources.inventory import read_inventory
from sparkweave.sources.responses import read_search_results, read_user_profiles
from sparkweave.streaming.cdc import land_changes, read_landed
from sparkweave.streaming.monitor import accumulate
from sparkweave.streaming import topics

def ntz(value: str):
    return F.lit(value).cast("timestamp_ntz")


# ---------------------------------------------------------------- projections

ETL_SPEC = EtlSpec(key="c_custkey", remove=("c_acctbal",), mask="c_name", label="c_mktsegment")


@register("etl_refine", """
    select c_custkey, substr(c_name, 1, 2) || '*****' as c_name, c_nationkey, c_mktsegment,
           'Not Implemented' as category_type
    from customer""")
def etl_refine(spark, d):
    return refine(table(spark, d, "customer"), ETL_SPEC)


@register("etl_lifecycle", """
    select substr(c_name, 1, 2) || '*****' as c_name, c_nationkey, c_mktsegment,
           'Not Implemented' as category_type
    from customer""")
def etl_lifecycle(spark, d):
    return ingest_refine_write(spark, f"{d.rstrip('/')}/customer.parquet", ETL_SPEC,
                               fresh_path(spark, "q/etl_lifecycle"), fmt="parquet")


LAST4_SQL = ("case when length({c}) <= 4 then repeat('*', length({c})) "
             "else repeat('*', length({c}) - 4) || right({c}, 4) end")


@register("mask_last4", f"""
    select c_custkey, {LAST4_SQL.format(c='c_name')} as c_name, sha256(c_mktsegment) as seg_hash
    from customer""")
def mask_last4(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", last4(F.col("c_name")).alias("c_name"), sha256(F.col("c_mktsegment")).alias("seg_hash"))


@register("clean_newlines", """
    select doc_id, replace(replace(text, chr(10), ' '), chr(13), ' ') as text from documents""")
def q_clean_newlines(spark, d):
    return table(spark, d, "documents").select("doc_id", clean_newlines(F.col("text")).alias("text"))


@register("array_filter_join", """
    select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: length(x) > 8), ', ') as keywords
    from documents""")
def array_filter_join(spark, d):
    return table(spark, d, "documents").select("doc_id", long_words_joined(F.col("text"), 9).alias("keywords"))


@register("json_decode", """
    select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events""")
def json_decode(spark, d):
    from sparkweave.functions.json import decode_json
    valid, _ = decode_json(table(spark, d, "events"), "props", T.StructType([T.StructField("k", T.IntegerType())]),
                           keep=["event_id"])
    return valid


@register("json_quarantine", """
    select event_id, case when event_id % 14 = 0 then props || ' trailing' else substr(props, 1, length(props) - 1) end as raw
    from events where event_id % 7 = 0""")
def json_quarantine(spark, d):
    """Every seventh message is broken (cut short, or followed by more text):
    exactly those reach the quarantine, as they came."""
    from sparkweave.functions.json import decode_json
    broken = (F.when(F.col("event_id") % 14 == 0, F.concat("props", F.lit(" trailing")))
              .when(F.col("event_id") % 7 == 0, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")))
    messages = table(spark, d, "events").select("event_id", broken.alias("props"))
    return decode_json(messages, "props", T.StructType([T.StructField("k", T.IntegerType())]), keep=["event_id"])[1]


# ------------------------------------------------------- landed API responses

@register("flatten_nested", """
    select c_mktsegment as title, c_name as first, n_name as last,
           cast(c_custkey as varchar) || ' ' || n_name as street, n_name as city,
           null::varchar as state, cast(c_nationkey as varchar) as postcode, null::varchar as country,
           null::varchar as gender, lower(c_name) || '@example.com' as email,
           md5(cast(c_custkey as varchar)) as uuid, c_name as username, null::varchar as password,
           null::varchar as phone, null::varchar as cell, null::varchar as dob, null::varchar as registered,
           null::varchar as large, null::varchar as medium, null::varchar as thumbnail,
           substr(n_name, 1, 2) as nat
    from customer join nation on c_nationkey = n_nationkey""")
def flatten_nested(spark, d):
    """Customers become user-profile API responses (landed as JSON lines,
    numeric postcode, several keys absent), then are flattened back."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    user = F.struct(
        F.struct(F.col("c_mktsegment").alias("title"), F.col("c_name").alias("first"),
                 F.col("n_name").alias("last")).alias("name"),
        F.struct(F.struct(F.col("c_custkey").alias("number"), F.col("n_name").alias("name")).alias("street"),
                 F.col("n_name").alias("city"), F.col("c_nationkey").alias("postcode")).alias("location"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.struct(F.md5(F.col("c_custkey").cast("string")).alias("uuid"),
                 F.col("c_name").alias("username")).alias("login"),
        F.substring("n_name", 1, 2).alias("nat"))
    landed = fresh_path(spark, "q/flatten_nested")
    c.select(F.to_json(F.struct(F.array(user).alias("results"))).alias("value")).write.text(landed)
    return read_user_profiles(spark, landed)


@register("flatten_search", """
    select cast(doc_id as varchar) as href, source as title, lang as description,
           case when lang = 'en' then lang || ', ' || source else '' end as keywords,
           'https://img.example/' || source as preview
    from documents""")
def flatten_search(spark, d):
    """Documents become search-API responses (keywords absent for non-English
    items, a non-preview link on every item), landed and flattened back."""
    dd = table(spark, d, "documents")
    data = F.struct(F.col("source").alias("title"), F.col("lang").alias("description"),
                    F.when(F.col("lang") == "en", F.array("lang", "source")).alias("keywords"))
    links = F.array(
        F.struct(F.concat(F.lit("https://img.example/"), F.col("source")).alias("href"), F.lit("preview").alias("rel")),
        F.struct(F.concat(F.lit("https://doc.example/"), F.col("doc_id").cast("string")).alias("href"),
                 F.lit("canonical").alias("rel")))
    item = F.struct(F.col("doc_id").cast("string").alias("href"), F.array(data).alias("data"), links.alias("links"))
    landed = fresh_path(spark, "q/flatten_search")
    (dd.select(F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("collection"))).alias("value"))
       .write.text(landed))
    out = read_search_results(spark, landed)
    return out.withColumn("preview", F.array_join("preview", " "))


# ------------------------------------------------------------ document queries

@register("search_terms", """
    select doc_id, lang, source, n_chars, term
    from documents, unnest(['missile', 'earthquake', 'tsunami', 'oil', 'flood', 'iraq', 'syria']) t(term)
    where contains(lower(text), term)""")
def q_search_terms(spark, d):
    return docs.search_terms(table(spark, d, "documents"), docs.DEFAULT_SEARCH_TERMS)


@register("search_terms_en", """
    select doc_id, source, 'the' as term from documents where lang = 'en' and contains(lower(text), 'the')""")
def q_search_terms_en(spark, d):
    return docs.search_terms(table(spark, d, "documents"), ["the"], keep=["doc_id", "source"],
                             where={"lang": "en"})


@register("doc_search", """
    select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice >= 400000""")
def doc_search(spark, d):
    return docs.search(table(spark, d, "orders"), select=["o_orderkey", "o_totalprice"],
                       where={"$and": [{"$eq": {"o_orderstatus": "F"}}, {"$ge": {"o_totalprice": 400000}}]})


@register("find_by_id", "select * from orders where o_orderkey = 42")
def find_by_id(spark, d):
    return docs.find_by_id(table(spark, d, "orders"), 42, key="o_orderkey")


@register("limit_peek", "select * from orders order by o_orderkey limit 10")
def limit_peek(spark, d):
    return docs.peek(table(spark, d, "orders"), 10, order_by=["o_orderkey"])


@register("table_query", "select * from lineitem where l_quantity > 40 and l_returnflag = 'R'")
def q_table_query(spark, d):
    return docs.table_query(table(spark, d, "lineitem"), "l_quantity > 40 and l_returnflag = 'R'")


# ------------------------------------------------------------------ statistics

@register("value_counts", """
    select event_type, count(*) as count from events where event_type is not null group by event_type""")
def value_counts(spark, d):
    return stats.value_counts(table(spark, d, "events"), "event_type")


@register("dataset_profile", """
    select count(*) as n_rows, cast(6 as integer) as n_cols,
           'event_id, ts, user_id, event_type, value, props' as cols from events""")
def dataset_profile(spark, d):
    return stats.profile(table(spark, d, "events"))


@register("size_summary", """
    select lang, source, count(*) as objects, cast(sum(n_chars) as bigint) as total_bytes,
           printf('%.2f MB', sum(n_chars) / 1048576.0::double) as total_size
    from documents group by lang, source""")
def size_summary(spark, d):
    return stats.size_summary(table(spark, d, "documents"), "n_chars", ["lang", "source"])


URL_KEY = r"^[a-z]+://[^/]+/(.*)$"


@register("prefix_summary", f"""
    select 'en/' as folder, count(*) as objects, cast(coalesce(sum(strlen(html)), 0) as bigint) as total_bytes,
           printf('%.2f MB', coalesce(sum(strlen(html)), 0) / 1048576.0::double) as total_size
    from pages where starts_with(regexp_extract(url, '{URL_KEY}', 1), 'en/')""")
def prefix_summary(spark, d):
    """Pages as objects: key = URL path, size = HTML bytes; prefix 'en' -> 'en/'."""
    p = table(spark, d, "pages")
    inv = p.select(F.regexp_extract("url", URL_KEY, 1).alias("path"), F.octet_length("html").cast("bigint").alias("length"))
    return stats.folder_summary(inv, "en")


@register("topic_stats", """
    select event_type as topic, cast(sum(strlen(props)) as bigint) / 1000.0::double as size_kb,
           max(event_id) + 1 as published
    from events group by event_type""")
def q_topic_stats(spark, d):
    """Stand-in topic: topic = event_type, offset = event_id, payload = props."""
    e = table(spark, d, "events")
    log = e.select(F.col("event_type").alias("topic"), F.col("event_id").alias("offset"), F.col("props").alias("value"))
    return stats.topic_stats(log)


@register("topic_retention", """
    select * from events where ts >= (select max(ts) from events) - interval 86400 seconds""")
def topic_retention(spark, d):
    return stats.retention(table(spark, d, "events"), "ts", 86_400)


@register("topic_retention_instants", """
    select event_id from events where ts >= (select max(ts) from events) - interval 10800 seconds""")
def topic_retention_instants(spark, d):
    """Retention over a column of instants (not wall-clock times)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stats.retention(e, "ts", 10_800).select("event_id")


@register("metric_downsample", """
    select time_bucket(interval '15 minutes', ts) as bucket, event_type, count(value) as n,
           min(value) as lo, max(value) as hi
    from events group by all""")
def metric_downsample(spark, d):
    return stats.downsample(table(spark, d, "events"), "ts", "value", "15 minutes",
                            {"n": "count", "lo": "min", "hi": "max"}, group_cols=["event_type"])


@register("metric_downsample_1d", """
    select time_bucket(interval '1 hour', ts) as bucket, round(avg(value), 6) as value
    from events where ts >= (select max(ts) from events) - interval 1 day group by all""")
def metric_downsample_1d(spark, d):
    out = stats.downsample(table(spark, d, "events"), "ts", "value", "1 hour", "avg", start="1d-ago")
    return out.withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------- streaming

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def _events_topic(spark, d) -> str:
    root = fresh_path(spark, "q/topics")
    topics.publish(table(spark, d, "events"), root, topic=F.col("event_type"), key="user_id")
    return root


@register("topic_produce", """
    select event_type as topic, count(*) as messages, count(*) as published, 0::bigint as min_offset
    from events group by event_type""")
def topic_produce(spark, d):
    """Publish events (topic = event_type, key = user_id).  Positions in a topic,
    dense from 0, are numbered without a single-task window, so published (max
    + 1) equals the number of messages."""
    sent = allocate_ids(topics.messages(spark, _events_topic(spark, d)), "offset", start=0, group_cols=["topic"])
    return sent.groupBy("topic").agg(F.count("*").alias("messages"), (F.max("offset") + 1).alias("published"), F.min("offset").alias("min_offset"))


@register("topic_lag", """
    select event_type as topic, count(*) + 1 as published,
           case when event_type = (select min(event_type) from events) then count(*) else 0 end as consumed
    from events group by event_type""")
def topic_lag(spark, d):
    """Consumer lag: one group reads one topic, then one more message arrives in
    every topic; topics that no group has read are at 0."""
    root = _events_topic(spark, d)
    names = table(spark, d, "events").select("event_type").distinct()
    topics.consume(spark, root, "lag-group", names.agg(F.min("event_type")).first()[0])
    topics.publish(names, root, topic=F.col("event_type"), key="event_type")
    return topics.topic_positions(spark, root).select("topic", "published", "consumed")


@register("metric_monitor", """
    select ts_ms, event_type, size_kb, published, consumed from (
      select epoch_us(max(ts)) // 1000 as ts_ms, event_type, cast(sum(strlen(props)) as bigint) / 1000.0::double as size_kb,
             max(event_id) + 1 as published, min(event_id) as consumed
      from events group by event_type)""")
def metric_monitor(spark, d):
    """The monitor as one flow: topic-info polls land as files (one per topic),
    a stream turns each into chart rows and appends them to the series."""
    e = table(spark, d, "events")
    info = e.groupBy("event_type").agg(
        F.unix_millis(F.max("ts").cast("timestamp")).alias("timestamp"), F.sum(F.octet_length("props")).alias("logicalsize"),
        F.max("event_id").alias("maxoffset"), F.min("event_id").alias("minoffsetacrossconsumers"))
    inbox = fresh_path(spark, "q/metric_polls")
    info.repartition("event_type").write.parquet(inbox)
    polls = spark.readStream.schema(info.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    series = fresh_path(spark, "q/metric_series")
    accumulate(polls.select("event_type", *stats.metric_snapshot_columns()), series, fresh_path(spark, "q/metric_ckpt"))
    return read_loads(spark, series).select(F.unix_millis("timestamp").alias("ts_ms"), "event_type", "size_kb", "published", "consumed")


@register("epoch_seconds", """
    select event_id, epoch_us(ts) // 1000000 as s, make_timestamp((epoch_us(ts) // 1000000) * 1000000) as at from events""")
def q_epoch_seconds(spark, d):
    """Epoch seconds of a metric point back to a timestamp."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", seconds.alias("s"), stats.epoch_seconds(seconds).cast("timestamp_ntz").alias("at"))


@register("topic_monitor", """
    select event_type as topic, count(*) as published, count(*) as consumed from events group by event_type""")
def topic_monitor(spark, d):
    """Topic statistics from the log and the committed positions of a
    consumer group that has read everything: consumed equals published."""
    root = _events_topic(spark, d)
    topics.consume(spark, root, "monitor-group")
    return topics.topic_positions(spark, root).select("topic", "published", "consumed")


@register("topic_consume", "select * from events")
def topic_consume(spark, d):
    """Publish events, consume them with a new group (bounded stream), decode."""
    rows, _ = topics.decode_messages(topics.consume(spark, _events_topic(spark, d), "analytics"), EVENTS_SCHEMA)
    return rows


@register("cdc_insert_only", "select * from orders where o_orderstatus = 'O'")
def cdc_insert_only(spark, d):
    """Orders as a change log (status O = insert, F = update, P = delete),
    landed by a checkpointed stream; only inserts reach the sinks."""
    o = table(spark, d, "orders")
    op = F.when(F.col("o_orderstatus") == "O", "insert").when(F.col("o_orderstatus") == "F", "update").otherwise("delete")
    changes = fresh_path(spark, "q/cdc_log")
    (o.select(op.alias("op"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("timestamp").alias("ts"), "*")
      .write.parquet(changes))
    out = fresh_path(spark, "q/cdc_out")
    land_changes(spark, changes, o.schema, out)
    return read_landed(spark, out, o.schema, "parquet")


@register("union_append", "select * from supplier union all select * from supplier")
def union_append(spark, d):
    """Two supplier snapshots arrive as files; a monitor stream appends each
    micro-batch to the accumulated series."""
    s = table(spark, d, "supplier")
    inbox = fresh_path(spark, "q/snapshots_in")
    s.write.mode("append").parquet(inbox)
    s.write.mode("append").parquet(inbox)
    snaps = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    series = fresh_path(spark, "q/snapshots")
    accumulate(snaps, series, fresh_path(spark, "q/snapshots_ckpt"))
    return read_loads(spark, series)


# ---------------------------------------------------------------------- tables

@register("upsert_merge", """
    select * from orders where o_orderdate < timestamp '1998-01-01'
    union all
    select * replace ('X' as o_orderstatus) from orders where o_orderdate >= timestamp '1998-01-01'""")
def upsert_merge(spark, d):
    """Target: orders before 1999; source: orders from 1998 with a new status.
    1998 rows are matched (replaced), later rows are inserted."""
    o = table(spark, d, "orders")
    root = fresh_path(spark, "q/upsert_merge")
    append_load(o.where(F.col("o_orderdate") < ntz("1999-01-01")), root)
    upsert_load(o.where(F.col("o_orderdate") >= ntz("1998-01-01")).withColumn("o_orderstatus", F.lit("X")), root, "o_orderkey")
    return read_latest(spark, root, "o_orderkey")


@register("table_merge", """
    select * from orders where o_orderdate < timestamp '1998-01-01'
    union all
    select * replace ('X' as o_orderstatus) from orders where o_orderdate >= timestamp '1998-01-01'""")
def table_merge(spark, d):
    """The same merge against a catalog table: SQL MERGE where the format
    supports it, else a new snapshot and an atomic location swap."""
    o = table(spark, d, "orders")
    name = f"sw_orders_{uuid.uuid4().hex[:10]}"
    create_table_if_absent(spark, name, o.schema, "parquet", location=fresh_path(spark, "q/table_merge"))
    append_to_table(o.where(F.col("o_orderdate") < ntz("1999-01-01")), name)
    merge_into_table(o.where(F.col("o_orderdate") >= ntz("1998-01-01")).withColumn("o_orderstatus", F.lit("X")),
                     name, "o_orderkey", fresh_path(spark, "q/table_merge"))
    return spark.table(name)


@register("table_merge_partitioned", """
    select * replace (case when o_orderkey % 10 = 0 then 'X' else o_orderstatus end as o_orderstatus) from orders
    union all
    select o_orderkey + 10000000, * exclude (o_orderkey) replace ('Y' as o_orderstatus) from orders where o_orderkey % 100 = 1""")
def table_merge_partitioned(spark, d):
    """A merge into a catalog table partitioned by order status: matched rows
    move to another partition, new rows open one more."""
    o = table(spark, d, "orders")
    name = f"sw_part_{uuid.uuid4().hex[:10]}"
    (o.write.format("parquet").partitionBy("o_orderstatus").option("path", fresh_path(spark, "q/table_merge_part")).saveAsTable(name))
    moved = o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    added = (o.where("o_orderkey % 100 = 1").withColumn("o_orderkey", (F.col("o_orderkey") + 10_000_000).cast(o.schema["o_orderkey"].dataType))
             .withColumn("o_orderstatus", F.lit("Y")))
    merge_into_table(moved.unionByName(added), name, "o_orderkey", fresh_path(spark, "q/table_merge_part_staged"))
    return spark.table(name).select(*o.columns)


@register("upsert_null_order", """
    select user_id, event_id, value from events
    qualify row_number() over (partition by user_id order by case when event_id % 3 = 0 then null else event_id end desc nulls last,
                               event_id desc) = 1""")
def upsert_null_order(spark, d):
    """Latest event per user where a third of the order values is NULL: a NULL
    is older than any other; among NULLs only, the second column decides."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    root = fresh_path(spark, "q/null_order")
    upsert_load(e.withColumn("seq", F.when(F.col("event_id") % 3 != 0, F.col("event_id"))), root, "user_id", order=["seq", "event_id"])
    return read_latest(spark, root, "user_id").drop("seq")


@register("insert_or_replace_latest", """
    select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1""")
def insert_or_replace_latest(spark, d):
    root = fresh_path(spark, "q/latest")
    upsert_load(table(spark, d, "events"), root, "user_id", order="event_id")
    return read_latest(spark, root, "user_id")


@register("schema_merge_append", """
    select *, null::varchar as tag from supplier
    union all
    select s_suppkey + 1000, null, s_nationkey, null, 'v' from supplier""")
def schema_merge_append(spark, d):
    s = table(spark, d, "supplier")
    root = fresh_path(spark, "q/schema_merge")
    append_load(s, root)
    append_load(s.select((F.col("s_suppkey") + 1000).alias("s_suppkey"), "s_nationkey", F.lit("v").alias("tag")), root)
    return read_loads(spark, root)


@register("schema_widen_append", """
    select n_nationkey::bigint as id, n_regionkey::double as x, null::varchar as tag, n_name as name from nation
    union all select s_suppkey + 5000000000, s_acctbal, 'v', null from supplier""")
def schema_widen_append(spark, d):
    """Appends whose types are wider (int to bigint, int to double) and whose
    columns differ: all loads read with the widest types."""
    root = fresh_path(spark, "q/schema_widen")
    append_load(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("x"), F.col("n_name").alias("name")), root)
    append_load(table(spark, d, "supplier").select((F.col("s_suppkey") + 5_000_000_000).alias("id"), F.col("s_acctbal").alias("x"), F.lit("v").alias("tag")), root)
    return read_loads(spark, root)


@register("csv_accumulate", "select * from supplier union all select * from supplier")
def csv_accumulate(spark, d):
    """Existing CSV + new rows: a load is added, old rows are not rewritten."""
    s = table(spark, d, "supplier")
    root = fresh_path(spark, "q/customers_csv")
    for _ in range(2):
        append_load(s, root, next_load(spark, root), fmt="csv")
    return read_loads(spark, root, "csv", s.schema)


@register("table_append", "select * from nation union all select * from nation")
def table_append(spark, d):
    n = table(spark, d, "nation")
    name = f"sw_nation_{uuid.uuid4().hex[:10]}"
    create_table_if_absent(spark, name, n.schema, "parquet", location=fresh_path(spark, "q/table_append"))
    append_to_table(n, name)
    append_to_table(n, name)
    return spark.table(name)


@register("id_allocate", """
    select cast(row_number() over (order by n_nationkey) + (select max(n_nationkey) + 1 from nation) as integer) as id,
           n_name
    from nation""")
def id_allocate(spark, d):
    """Existing table holds ids 1..max; new rows get the next ids in key order."""
    n = table(spark, d, "nation")
    existing = n.select((F.col("n_nationkey") + 1).alias("id"))
    start = (existing.agg(F.max("id")).first()[0] or 0) + 1
    out = allocate_ids(n.select("n_nationkey", "n_name"), "id", start=start, order_by=["n_nationkey"])
    return out.select(F.col("id").cast("int").alias("id"), "n_name")


# --------------------------------------------------------------- files & JDBC

@register("csv_roundtrip", "select * from customer")
def csv_roundtrip(spark, d):
    c = table(spark, d, "customer")
    p = fresh_path(spark, "q/csv")
    write_any(c, p, "csv")
    return read_any(spark, p, "csv", c.schema)


@register("csv_multiline_roundtrip", "select * from documents")
def csv_multiline_roundtrip(spark, d):
    """Whole document texts (newlines, quotes) through CSV and back."""
    dd = table(spark, d, "documents")
    p = fresh_path(spark, "q/csv_text")
    write_any(dd, p, "csv")
    return read_any(spark, p, "csv", dd.schema, multi_line=True)


@register("csv_lossless", """
    select doc_id, chr(32) || chr(32) || source || chr(32) as padded, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then null else lang end as note,
           chr(10) || source as first_line
    from documents""")
def csv_lossless(spark, d):
    """White space, empty strings, NULLs and leading newlines through CSV."""
    dd = table(spark, d, "documents")
    note = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 2, F.col("lang"))
    rows = dd.select("doc_id", F.concat(F.lit("  "), "source", F.lit(" ")).alias("padded"), note.alias("note"),
                     F.concat(F.lit("\n"), "source").alias("first_line"))
    p = fresh_path(spark, "q/csv_lossless")
    write_any(rows, p, "csv")
    return read_any(spark, p, "csv", rows.schema, multi_line=True)


@register("parquet_roundtrip", "select * from lineitem")
def parquet_roundtrip(spark, d):
    li = table(spark, d, "lineitem")
    p = fresh_path(spark, "q/parquet")
    write_any(li, p, "parquet")
    return read_any(spark, p, "parquet")


@register("json_roundtrip", "select * from events")
def json_roundtrip(spark, d):
    e = table(spark, d, "events")
    p = fresh_path(spark, "q/json")
    write_any(e, p, "json")
    return read_any(spark, p, "json", e.schema)


@register("parquet_schema_scan", "select n_nationkey, n_name, null::varchar as missing from nation")
def parquet_schema_scan(spark, d):
    """Glob scan with a fixed schema: a column absent from the files reads NULL."""
    p = fresh_path(spark, "q/staging")
    table(spark, d, "nation").write.parquet(p)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()),
                           T.StructField("missing", T.StringType())])
    return read_parquet(spark, f"{p}/*.parquet", schema)


@register("jdbc_roundtrip", "select * from nation")
def jdbc_roundtrip(spark, d):
    """Write nation into a relational table whose id the database allocates,
    read it back with a partitioned scan.  The in-memory Derby database lives
    in this JVM only (local mode); on a cluster point ``url`` at a server."""
    url = f"jdbc:derby:memory:sw{uuid.uuid4().hex[:12]};create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    jdbc.execute(spark, url, "CREATE TABLE nation_t (id INT GENERATED ALWAYS AS IDENTITY PRIMARY KEY, "
                             "n_nationkey INT, n_name CLOB, n_regionkey INT)", props)
    jdbc.write_table(table(spark, d, "nation"), url, "nation_t", props)
    back = jdbc.read_table(spark, url, "nation_t", props, partition_column="n_nationkey", num_partitions=4)
    return back.select("n_nationkey", "n_name", "n_regionkey")


@register("object_inventory", """
    select 'lang=' || lang as folder, sum(strlen(coalesce(text, '')) + 1)::bigint as total_bytes,
           printf('%.2f MB', sum(strlen(coalesce(text, '')) + 1) / 1048576.0::double) as total_size
    from documents group by lang""")
def object_inventory(spark, d):
    """Texts landed per language folder, one a line; Spark's listing of them,
    summarised per folder (how many files there are depends on the writer)."""
    root = fresh_path(spark, "q/inventory")
    table(spark, d, "documents").select("lang", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("lang").text(root)
    inventory = read_inventory(spark, root).withColumn("folder", F.regexp_extract("path", "^([^/]+)/", 1))
    return stats.size_summary(inventory.where("folder != ''"), "length", ["folder"]).drop("objects")


# ------------------------------------------------------------------ governance

CUSTOMER_POLICY = [("c_name", "first2"), ("c_mktsegment", "last4")]


def _policy(spark):
    p = empty_policy(spark)
    for col, mask in CUSTOMER_POLICY:
        p = set_mask(p, "customer", col, mask)
    return p


@register("masked_read_public", f"""
    select c_custkey, substr(c_name, 1, 2) || '*****' as c_name, c_nationkey, c_acctbal,
           {LAST4_SQL.format(c='c_mktsegment')} as c_mktsegment
    from customer""")
def masked_read_public(spark, d):
    return masked_view(table(spark, d, "customer"), _policy(spark), "customer", principal="public")


@register("masked_read_owner", "select * from customer")
def masked_read_owner(spark, d):
    return masked_view(table(spark, d, "customer"), _policy(spark), "customer", principal="owner")


@register("document_table_public", f"""
    select c_custkey, substr(c_name, 1, 2) || '*****' as c_name, c_nationkey, c_acctbal,
           {LAST4_SQL.format(c='c_mktsegment')} as c_mktsegment
    from customer""")
def document_table_public(spark, d):
    """Customers added to a document table, masks set through the table's
    policy, read back by a public (masked) reader."""
    c = table(spark, d, "customer")
    t = DocumentTable(spark, fresh_path(spark, "q/doc_table"), name="customer", key="c_custkey")
    t.create(c.schema)
    t.add(c)
    t.set_masks(dict(CUSTOMER_POLICY))
    return t.read("public")


@register("policy_masks", """
    select p."column", p.mask, count(*) as documents, count(case p."column" when 'c_name' then c_name else c_mktsegment end) as masked_values,
           count(distinct case p."column" when 'c_name' then c_name else c_mktsegment end) as distinct_values
    from customer, (values ('c_mktsegment', 'last4'), ('c_name', 'first2')) p("column", mask) group by all""")
def policy_masks(spark, d):
    """The masks of a document table, with what they hide: the documents, and
    the values and distinct values of each masked column."""
    c = table(spark, d, "customer")
    t = DocumentTable(spark, fresh_path(spark, "q/doc_masks"), name="customer", key="c_custkey")
    t.create(c.schema)
    t.insert(c)
    t.set_masks(dict(CUSTOMER_POLICY))
    return masked_columns(t.read("owner"), t.get_masks())


@register("document_insert", "select * from customer")
def document_insert(spark, d):
    """Two plain inserts of different documents; the owner reads them all."""
    c = table(spark, d, "customer")
    t = DocumentTable(spark, fresh_path(spark, "q/doc_insert"), name="customer", key="c_custkey")
    t.create(c.schema)
    t.insert(c.where("c_custkey % 2 = 0"))
    t.insert(c.where("c_custkey % 2 = 1"))
    return t.read("owner")


@register("put_object", "select * from supplier")
def q_put_object(spark, d):
    """Each content type's writer, read back by suffix; an empty refinement
    falls back to the source."""
    s = table(spark, d, "supplier")
    bucket = fresh_path(spark, "q/bucket")
    third = F.pmod("s_suppkey", F.lit(3))
    out = None
    for i, kind in enumerate(("text/csv", "application/json", "application/octet-stream")):
        part = s.where(third == i)
        back = read_any(spark, put_object(choose_output(part.limit(0), part), bucket, f"part{i}", kind), schema=s.schema)
        out = back if out is None else out.unionByName(back)
    return out


@register("tenant_scope", """
    select * from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)""")
def q_tenant_scope(spark, d):
    """Grants: principal 'tenant<r>' may read the nations of region r."""
    n = table(spark, d, "nation")
    grants = n.select(F.concat(F.lit("tenant"), F.col("n_regionkey").cast("string")).alias("principal"),
                      F.col("n_nationkey").alias("tenant"), F.lit(True).alias("can_read"),
                      (F.col("n_regionkey") == 1).alias("can_write"))
    return tenant_scope(table(spark, d, "customer"), grants, "tenant1", "c_nationkey")


# Queries with state, nested data, access rules and indexes register themselves.
from sparkweave.plans import catalog_access, catalog_columns, catalog_nested, catalog_state  # noqa: E402, F401
