"""Who may read or write what: rules over users and groups (JN-2, GOV-5).

A rule is written like ``g:tenant1 & !u:guest | u:admin``: users, groups, ``p``
(everyone known), and (``&``), or (``|``), not (``!``) and parentheses; an empty
or broken rule lets nobody in.  Groups may be members of groups, in cycles
too: membership is closed transitively, level by level, from the principals
that ask.

Rules are data.  Each distinct rule is brought to postfix order once, joined with
what its principals hold of the users and groups it names, and decided by one
expression inside Spark; data rows then follow by a join on the resource.

Like every view here it is a convenience, not a security boundary.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.session import written

#: A user, a group, everyone; the signs of a rule.
_TOKEN = re.compile(r"\s*([ug]:[\w.@-]+|p\b|[&|!()])")
_BINDS = {"|": 1, "&": 2, "!": 3}


def postfix(rule: str | None) -> list[str] | None:
    """The rule's parts in the order of evaluation; None if it isn't a rule."""
    out: list[str] = []
    waiting: list[str] = []
    at, operand = 0, True  # whether an operand has to come next
    rule = (rule or "").rstrip()
    while at < len(rule):
        m = _TOKEN.match(rule, at)
        if not m:
            return None
        at, t = m.end(), m[1]
        if (t in "!(" or t not in _BINDS and t != ")") != operand:
            return None
        if t == "(" or t == "!":
            waiting.append(t)
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in _BINDS:
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = True
        else:
            out.append(t)
            operand = False
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _postfix(rules: pd.Series) -> pd.Series:
    return rules.map(postfix)


def decided(order: Column, held: Column) -> Column:
    """Truth of a rule in postfix order for someone who holds ``held``."""
    push = lambda s, keep, v: F.concat(F.slice(s, 1, F.greatest(F.size(s) - keep, F.lit(0))), F.array(v))
    last = lambda s, n: F.coalesce(F.get(s, F.size(s) - n), F.lit(False))

    def step(s: Column, t: Column) -> Column:
        return (F.when(t == "&", push(s, 2, last(s, 1) & last(s, 2))).when(t == "|", push(s, 2, last(s, 1) | last(s, 2)))
                .when(t == "!", push(s, 1, ~last(s, 1))).when(t == "p", push(s, 0, F.lit(True)))
                .otherwise(push(s, 0, F.array_contains(held, t))))

    result = F.aggregate(order, F.array().cast("array<boolean>"), step, lambda s: F.get(s, 0))
    return F.coalesce(result, F.lit(False))


def closed_membership(membership: DataFrame, principals: Iterable[str]) -> DataFrame:
    """``principal`` and ``subject``: all that each known principal is, itself and
    the groups it is in, directly or through groups.

    ``membership`` has ``member`` and ``grp``, both with their ``u:`` or ``g:``.
    A principal is known if it is a member of anything.  Each step joins only
    what was found in the last one, and ends where nothing new is."""
    spark = membership.sparkSession
    edges = written(membership.select("member", "grp").where("member IS NOT NULL AND grp IS NOT NULL").distinct(), "membership")
    asked = spark.createDataFrame([(p,) for p in sorted(set(principals))], "principal string")
    found = written(asked.join(edges, asked["principal"] == edges["member"], "left_semi").select("principal", F.col("principal").alias("subject")), "subjects")
    new = found
    while True:
        up = new.join(edges, new["subject"] == edges["member"]).select("principal", F.col("grp").alias("subject")).distinct()
        new = written(up.join(found, ["principal", "subject"], "left_anti"), "subjects")
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def allowed_resources(rules: DataFrame, membership: DataFrame, principals: Iterable[str]) -> DataFrame:
    """``principal``, ``access`` and ``resource`` for what each may do.

    ``rules``: resource, access, rule.  Several rules for one resource and kind of
    access each let in whom they let in.  Unknown principals get nothing."""
    principals = sorted(set(principals))
    subjects = closed_membership(membership, principals)
    wanted = rules.select("resource", "access", "rule").distinct()
    orders = written(wanted.select("rule").distinct().withColumn("order", _postfix("rule")).where(F.col("order").isNotNull()), "rules")
    known = subjects.select("principal").distinct()
    # The principals that ask are few; each rule is decided once for each of them.
    asked = F.array(*[F.lit(p) for p in principals]).cast("array<string>")
    pairs = orders.withColumn("principal", F.explode(asked)).join(known, "principal", "left_semi")
    names = orders.select("rule", F.explode(F.array_distinct("order")).alias("subject"))
    held = names.join(subjects, "subject").groupBy("principal", "rule").agg(F.collect_set("subject").alias("held"))
    allowed = (pairs.join(held, ["principal", "rule"], "left")
               .where(decided(F.col("order"), F.coalesce("held", F.array().cast("array<string>")))))
    return wanted.join(allowed.select("principal", "rule"), "rule").select("principal", "access", "resource").distinct()


def acl_scope(df: DataFrame, rules: DataFrame, membership: DataFrame, principal: str, resource_col: str, access: str = "read") -> DataFrame:
    """Rows of ``df`` whose resource the principal may access (semi join)."""
    allowed = allowed_resources(rules.where(F.col("access") == access), membership, [principal]).select(F.col("resource").alias("_resource"))
    return df.join(allowed, df[resource_col] == allowed["_resource"], "left_semi")


def accessible_rows(df: DataFrame, rules: DataFrame, membership: DataFrame, principals: Iterable[str], resource_col: str) -> DataFrame:
    """For several principals at once: ``principal``, ``access`` and the rows of
    ``df`` that it may access so."""
    allowed = allowed_resources(rules, membership, principals).withColumnRenamed("resource", "_resource")
    return df.join(allowed, df[resource_col] == allowed["_resource"]).select(allowed["principal"], allowed["access"], *[df[c] for c in df.columns])


def broken_rules(rules: DataFrame) -> DataFrame:
    """Rules that let nobody in because they can't be read."""
    texts = rules.select("rule").distinct()
    return texts.where(_postfix("rule").isNull())


def empty_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "resource string, access string, rule string")
