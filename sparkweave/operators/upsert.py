"""Key-based upsert, merge and schema-merging append (SNK-12..16, JN-1).

Latest-wins de-duplication uses ``max_by`` in a grouped aggregation, which
Spark pre-aggregates inside every task: a key holding a third of the rows
reaches the shuffle as one row per task.  The merge itself is an anti join
on the key plus a by-name union; its strategy (broadcast of a small update
batch, or sort-merge with AQE skew splitting) is left to the planner.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_per_key(df: DataFrame, key: str | list[str], order: str | list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order``, column by column.

    A NULL order is older than any other (a key with NULL orders only keeps one
    of its rows); rows with the same order are told apart by a hash of the
    whole row, so the choice does not depend on partitioning."""
    keys, order_cols = _keys(key), _keys(order)
    ordering = F.struct(*[x for c in order_cols for x in (F.col(c).isNotNull(), F.col(c))],
                        F.xxhash64(*df.columns))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ordering).alias("_r"))
              .select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns]))


def check_keys(df: DataFrame, key: str | list[str], unique: bool = False) -> None:
    """NULL keys never match, so they would be inserted again on every run.
    With ``unique``, a key that occurs twice is refused as well: without an
    order nothing says which of its rows should replace the old one."""
    cond = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in _keys(key)])
    if df.where(cond).limit(1).count() > 0:
        raise ValueError(f"NULL values in upsert key {key!r}")
    if unique and not df.groupBy(*_keys(key)).count().where("count > 1").isEmpty():
        raise ValueError(f"several rows with the same upsert key {key!r}; name an order")


def upsert(target: DataFrame, updates: DataFrame, key: str | list[str],
           order: str | list[str] | None = None, null_keys: str = "error") -> DataFrame:
    """Insert-or-replace: rows of ``updates`` replace whole target rows with
    the same key, other update rows are inserted.  With ``order`` duplicate
    keys in ``updates`` are reduced to the latest one first; without it they are
    refused.

    Columns only in ``updates`` are added (NULL for old rows); columns only in
    ``target`` are NULL in replaced rows (a full replace, not a patch).
    """
    keys = _keys(key)
    if null_keys == "error":
        check_keys(updates, keys, unique=order is None)
    src = latest_per_key(updates, keys, order) if order is not None else updates
    kept = target.join(src.select(*keys), keys, "left_anti")
    return kept.unionByName(src, allowMissingColumns=True)


def merge(target: DataFrame, source: DataFrame, key: str | list[str],
          order: str | list[str] | None = None) -> DataFrame:
    """MERGE: matched -> update all columns, not matched -> insert all."""
    return upsert(target, source, key, order=order)


def append_merge(target: DataFrame, new: DataFrame) -> DataFrame:
    """Append with schema merge: union by name, missing columns NULL."""
    return target.unionByName(new, allowMissingColumns=True)
