"""Registered queries on folder trees, access rules and the search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.operators.access import accessible_rows
from sparkweave.operators.documents import DEFAULT_SEARCH_TERMS
from sparkweave.operators.search_index import SearchIndex
from sparkweave.operators.tree import folder_tree
from sparkweave.plans.registry import register, table
from sparkweave.session import fresh_path


@register("dir_tree", """
    with recursive files as (
      select regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/{2,}', '/', 'g'), '^/', '') as path,
        strlen(html)::bigint as n, page_id from pages),
    up as (
      select regexp_replace(path, '/?[^/]*$', '') as folder, n, page_id, 1 as direct from files
      union all select regexp_replace(folder, '/?[^/]*$', ''), n, page_id, 0 from up where folder <> '')
    select folder, case when folder = '' then 0 else length(folder) - length(replace(folder, '/', '')) + 1 end::int as depth, count(*) as objects,
      coalesce(sum(n), 0)::bigint as total_bytes, max(page_id) as newest, sum(direct)::bigint as direct_objects
    from up group by folder""")
def dir_tree(spark, d):
    """Pages as objects of a tree: host and URL path are folders, HTML bytes are
    sizes, the page number stands for the time."""
    inventory = table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"),
                                                F.octet_length("html").cast("long").alias("length"), F.col("page_id").alias("modified"))
    return folder_tree(inventory)


PRINCIPALS = ["u:root", "u:chief1", "u:chief3", "u:nation3", "u:nation7", "u:nation12", "u:stranger"]

_MEMBERS_SQL = """
    members as (
      select 'u:nation' || n_nationkey as member, 'g:nation' || n_nationkey as grp from nation
      union all select 'g:nation' || n_nationkey, 'g:region' || n_regionkey from nation
      union all select 'u:chief' || r_regionkey, 'g:region' || r_regionkey from region
      union all select 'g:region' || r_regionkey, 'g:world' from region
      union all select 'g:world', 'g:all' union all select 'g:all', 'g:world'
      union all select 'u:root', 'g:admin'),
    held as (
      select distinct member as principal, member as subject from members where starts_with(member, 'u:')
      union select principal, grp from held join members on member = subject)"""


@register("acl_scope", f"""
    with recursive {_MEMBERS_SQL},
    has as (select principal, list(distinct subject) as s from held group by principal),
    data as (
      select 'customer' as kind, c_custkey as id, c_nationkey as n, n_regionkey as r from customer join nation on c_nationkey = n_nationkey
      union all select 'supplier', s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey
      union all select 'nation', n_nationkey, null, n_regionkey from nation
      union all select 'region', r_regionkey, null, null from region)
    select principal, 'read' as access, kind, id from data, has
    where principal in ({', '.join(repr(p) for p in PRINCIPALS)}) and case
      when n is not null then list_contains(s, 'g:region' || r) and not list_contains(s, 'u:nation' || 7 * (n // 7 + 1)) or list_contains(s, 'g:admin')
      when r is not null then list_contains(s, 'g:world') and (list_contains(s, 'g:region' || r) or not list_contains(s, 'u:nation3'))
      else true end
    union all select principal, 'write', kind, id from data, has
    where principal in ({', '.join(repr(p) for p in PRINCIPALS)}) and case
      when n is not null then list_contains(s, 'u:nation' || n) or list_contains(s, 'g:admin')
      when r is not null then list_contains(s, 'u:chief' || r)
      else list_contains(s, 'u:root') and not list_contains(s, 'g:world') end""")
def acl_scope(spark, d):
    """Customers and suppliers belong to their nation, nations to their region,
    regions to everyone; each has its rules, over users and nested groups (the
    two widest are in each other).  What each principal may read and write."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    pairs = [n.select(text("u:nation", "n_nationkey"), text("g:nation", "n_nationkey")), n.select(text("g:nation", "n_nationkey"), text("g:region", "n_regionkey")),
             r.select(text("u:chief", "r_regionkey"), text("g:region", "r_regionkey")), r.select(text("g:region", "r_regionkey"), F.lit("g:world")),
             spark.createDataFrame([("g:world", "g:all"), ("g:all", "g:world"), ("u:root", "g:admin")], "member string, grp string")]
    membership = pairs[0]
    for p in pairs[1:]:
        membership = membership.union(p)
    membership = membership.toDF("member", "grp")

    seventh = (7 * (F.floor(F.col("n_nationkey") / 7) + 1)).cast("string")
    rule = lambda resource, access, *parts: (resource.alias("resource"), F.lit(access).alias("access"), F.concat(*parts).alias("rule"))
    nation, region = text("nation/", "n_nationkey"), text("region/", "r_regionkey")
    rules = (n.select(*rule(nation, "read", text("g:region", "n_regionkey"), F.lit(" & !u:nation"), seventh, F.lit(" | g:admin")))
             .union(n.select(*rule(nation, "write", text("u:nation", "n_nationkey"), F.lit("|g:admin"))))
             .union(r.select(*rule(region, "read", F.lit("g:world & ("), text("g:region", "r_regionkey"), F.lit(" | !u:nation3)"))))
             .union(r.select(*rule(region, "write", text("u:chief", "r_regionkey"))))
             .union(spark.createDataFrame([("public", "read", "p"), ("public", "write", "u:root & !g:world"), ("public", "write", "u:root & ")],
                                          "resource string, access string, rule string")))

    row = lambda kind, id_, resource: (F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), resource.alias("resource"))
    data = (c.select(*row("customer", "c_custkey", text("nation/", "c_nationkey"))).union(s.select(*row("supplier", "s_suppkey", text("nation/", "s_nationkey"))))
            .union(n.select(*row("nation", "n_nationkey", text("region/", "n_regionkey")))).union(r.select(*row("region", "r_regionkey", F.lit("public")))))
    return accessible_rows(data, rules, membership, PRINCIPALS, "resource").drop("resource")


SEARCHED = [*DEFAULT_SEARCH_TERMS, "tion de", "no such words", "qu"]


@register("search_index", f"""
    select doc_id, lang, source, n_chars, term
    from documents, unnest([{', '.join(repr(t) for t in SEARCHED)}]) t(term)
    where contains(lower(text), term)""")
def search_index(spark, d):
    """The texts indexed in two parts; the terms are those that ``search_terms``
    looks for in all texts, common, absent and very short ones."""
    docs = table(spark, d, "documents")
    index = SearchIndex(spark, fresh_path(spark, "q/search_index"), "doc_id", buckets=16)
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1"))
    return index.search(docs, SEARCHED)
