"""Registered queries on nested data and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.functions.json_union import decode_union
from sparkweave.functions.nested import masked_documents
from sparkweave.plans.registry import register, table
from sparkweave.session import fresh_path
from sparkweave.sinks.json_array import read_json_array, write_json_array


@register("json_union_keys", """
    select event_id, event_type,
      case event_type when 'click' then cast(event_id as varchar) when 'view' then cast(event_id as varchar) else 'e' || event_id end as id,
      case event_type when 'click' then event_id % 100 when 'error' then event_id % 7 + 0.5 end::double as v,
      case event_type when 'view' then cast(user_id as varchar) when 'purchase' then 'name ' || user_id end as u_name,
      case event_type when 'view' then 1 when 'purchase' then 2.25 end::double as u_n,
      case when event_type = 'purchase' then event_id % 2 = 0 end as u_flag,
      case when event_type = 'signup' then 'a|' || user_id end as tags
    from events""")
def json_union_keys(spark, d):
    """Messages whose keys, types and nesting differ by event type: ``id`` is a
    number or text, ``v`` whole or not, ``u`` a struct with other fields each
    time.  Nothing is said of their schema."""
    e = table(spark, d, "events")
    kind, text = F.col("event_type"), lambda c: F.col(c).cast("string")
    named = F.concat(F.lit("e"), text("event_id")).alias("id")
    json = lambda *c: F.to_json(F.struct(*c))
    value = (F.when(kind == "click", json(F.col("event_id").alias("id"), (F.col("event_id") % 100).alias("v")))
             .when(kind == "view", json(F.col("event_id").alias("id"), F.struct(text("user_id").alias("name"), F.lit(1).alias("n")).alias("u")))
             .when(kind == "purchase", json(named, F.struct(F.concat(F.lit("name "), text("user_id")).alias("name"), F.lit(2.25).cast("double").alias("n"),
                                                            (F.col("event_id") % 2 == 0).alias("flag")).alias("u")))
             .when(kind == "signup", json(named, F.array(F.lit("a"), text("user_id")).alias("tags")))
             .otherwise(json(named, F.when(kind == "error", (F.col("event_id") % 7 + F.lit(0.5)).cast("double")).alias("v"))))
    rows, _ = decode_union(e.select("event_id", "event_type", value.alias("value")), "value", keep=["event_id", "event_type"])
    return rows.select("event_id", "event_type", "id", "v", F.col("u.name").alias("u_name"), F.col("u.n").alias("u_n"), F.col("u.flag").alias("u_flag"),
                       F.array_join("tags", "|").alias("tags"))


TURN_RULES = {"turns[].text": "form", "turns[].role": "first2", "contact.iban": "form_last4"}


@register("nested_masks", """
    with nested as (
      select conv_id, list({'turn': turn, 'role': role, 'text': text} order by turn) as turns,
        'FR' || lpad(cast(conv_id as varchar), 6, '0') || '-' || lpad(cast(count(*) as varchar), 4, '0') as iban
      from conversations group by conv_id),
    masked as (
      select 'public' as principal, conv_id,
        list_transform(turns, lambda t: {'turn': t.turn, 'role': substr(t.role, 1, 2) || '*****',
          'text': regexp_replace(regexp_replace(regexp_replace(t.text, '\\p{Lu}', 'X', 'g'), '\\p{L}', 'x', 'g'), '\\p{N}', '9', 'g')}) as turns,
        'XX999999-' || right(iban, 4) as iban
      from nested),
    shown as (
      select principal, conv_id, list_transform(turns, lambda t: {'turn': t.turn, 'role': t.role, 'text': replace(t.text, 'X', 'x')}) as turns, iban from masked
      union all select 'owner', conv_id, list_transform(turns, lambda t: {'turn': t.turn, 'role': t.role, 'text': t.text}), iban from nested)
    select principal, conv_id, len(turns) as n_turns, list_sum(list_transform(turns, lambda t: t.turn))::bigint as turn_sum,
      array_to_string(list_transform(turns, lambda t: t.role), '|') as roles, array_to_string(list_transform(turns, lambda t: t.text), '|') as texts, iban
    from shown""")
def nested_masks(spark, d):
    """Conversations as documents (an array of turns, a struct with a contact),
    masked inside for the public and raw for the owner."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    iban = F.concat(F.lit("FR"), pad(F.col("conv_id"), 6), F.lit("-"), pad(F.count("*"), 4))
    documents = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"), F.struct(iban.alias("iban")).alias("contact"))
    out = None
    for principal in ("public", "owner"):
        seen = masked_documents(documents, TURN_RULES, principal)
        flat = seen.select(F.lit(principal).alias("principal"), "conv_id", F.size("turns").cast("long").alias("n_turns"),
                           F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t.turn).alias("turn_sum"),
                           F.array_join(F.transform("turns", lambda t: t.role), "|").alias("roles"),
                           F.array_join(F.transform("turns", lambda t: F.replace(t.text, F.lit("X"), F.lit("x")) if principal == "public" else t.text), "|").alias("texts"),
                           F.col("contact.iban").alias("iban"))
        out = flat if out is None else out.unionByName(flat)
    return out


@register("json_array_export", "select * from documents")
def json_array_export(spark, d):
    """Documents (newlines, quotes, accents) as the parts of one JSON array, and
    back."""
    docs = table(spark, d, "documents")
    out = fresh_path(spark, "q/json_array")
    write_json_array(docs, out)
    return read_json_array(spark, out, docs.schema)
