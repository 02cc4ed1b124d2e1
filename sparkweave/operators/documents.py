"""Document-table queries (FLT-1..4, PRJ-9, LIM-1).

``compile_where`` turns a JSON-style condition into a Spark ``Column`` so the
predicate is planned by Catalyst (and pushed into the Parquet scan).

Condition grammar (ours; the reference passes its dict to a remote store):
  {"$and": [c, ...]}  {"$or": [c, ...]}  {"$not": c}
  {"$eq"|"$ne"|"$lt"|"$le"|"$gt"|"$ge": {"field": value}}
  {"$in"|"$nin": {"field": [values]}}  {"$like": {"field": "pattern"}}
  {"$exists": "field"}  {"$notexists": "field"}
  {"field": value}  (equality; several keys in one dict are ANDed)
Fields may be dotted paths into structs.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CMP = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$le": lambda c, v: c <= F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$ge": lambda c, v: c >= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$like": lambda c, v: c.like(v),
}


def _and(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cs) if cs else F.lit(True)


def compile_where(cond: dict[str, Any] | None) -> Column:
    if not cond:
        return F.lit(True)
    parts: list[Column] = []
    for k, v in cond.items():
        if k == "$and":
            parts.append(_and([compile_where(x) for x in v]))
        elif k == "$or":
            parts.append(reduce(lambda a, b: a | b, [compile_where(x) for x in v]))
        elif k == "$not":
            parts.append(~compile_where(v))
        elif k == "$exists":
            parts.append(F.col(v).isNotNull())
        elif k == "$notexists":
            parts.append(F.col(v).isNull())
        elif k in _CMP:
            parts.append(_and([_CMP[k](F.col(f), val) for f, val in v.items()]))
        elif k.startswith("$"):
            raise ValueError(f"unknown operator {k!r}")
        else:
            parts.append(F.col(k) == F.lit(v))
    return _and(parts)


def find_by_id(df: DataFrame, doc_id: Any, key: str = "_id") -> DataFrame:
    """0 or 1 rows (a point lookup; pushed into the scan as an equality)."""
    return df.where(F.col(key) == F.lit(doc_id))


def search(df: DataFrame, select: list[str] | None = None, where: dict | None = None) -> DataFrame:
    out = df.where(compile_where(where))
    return out.select(*select) if select else out


def peek(df: DataFrame, limit: int | None = 10, order_by: list[str] | None = None) -> DataFrame:
    """First ``limit`` documents (``None`` = all).  With ``order_by`` the
    answer is repeatable (planned as a top-k, no global sort)."""
    if limit is None:
        return df
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(limit)


def table_query(df: DataFrame, expr: str = "") -> DataFrame:
    """Filter with a SQL boolean expression (SQL NULL semantics)."""
    return df.where(F.expr(expr)) if expr and expr.strip() else df


# The search terms offered by the reference's search page.
DEFAULT_SEARCH_TERMS = ["missile", "earthquake", "tsunami", "oil", "flood", "iraq", "syria"]


def search_terms(df: DataFrame, terms: list[str], text_col: str = "text",
                 keep: list[str] | None = None, where: dict | None = None) -> DataFrame:
    """Rows of ``df`` (filtered by ``where``, e.g. a media type / language)
    whose text contains a term, case-insensitively: one output row per
    (row, matching term) with a ``term`` column.  The whole text is searched."""
    keep = keep or [c for c in df.columns if c != text_col]
    text = F.lower(F.col(text_col))
    found = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: text.contains(t))
    return df.where(compile_where(where)).select(*keep, F.explode(found).alias("term"))
