"""Masking policies, per-principal views and tenant scoping (GOV-1..5, JN-2).

A view built here is a convenience, not a security boundary: anyone who can
read the underlying files sees the raw values.  Enforce access on storage.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.masks import MASKS, apply_mask

POLICY_SCHEMA = "table string, column string, mask string"


def list_masks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, d) for n, (d, _) in MASKS.items()], "name string, description string")


def empty_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], POLICY_SCHEMA)


def set_mask(policy: DataFrame, table: str, column: str, mask: str,
             columns: Iterable[str] | None = None) -> DataFrame:
    """Policy with (table, column) set to ``mask`` (replacing an older rule)."""
    if mask not in MASKS:
        raise ValueError(f"unknown mask {mask!r}")
    if columns is not None and column not in set(columns):
        raise ValueError(f"unknown column {column!r} for table {table!r}")
    row = policy.sparkSession.createDataFrame([(table, column, mask)], POLICY_SCHEMA)
    same = (F.col("table") == table) & (F.col("column") == column)
    return policy.where(~same).unionByName(row)


def get_masks(policy: DataFrame, table: str) -> DataFrame:
    return policy.where(F.col("table") == table).select("column", "mask")


def masked_view(df: DataFrame, policy: DataFrame, table: str, principal: str,
                unmasked_readers: Iterable[str] = ("owner",)) -> DataFrame:
    """Principals in ``unmasked_readers`` read raw values; everyone else
    reads the masked projection.  The policy holds one row per masked
    column, so it is read on the driver to build a single ``select``."""
    if principal in set(unmasked_readers):
        return df
    rules = {r["column"]: r["mask"] for r in get_masks(policy, table).collect()}
    unknown = set(rules) - set(df.columns)
    if unknown:
        raise ValueError(f"policy names unknown columns {sorted(unknown)}")
    return df.select(*[apply_mask(rules[c], F.col(c)).alias(c) if c in rules else F.col(c) for c in df.columns])


def masked_columns(df: DataFrame, masks: DataFrame) -> DataFrame:
    """The masks of a table (column, mask) with what they hide: ``documents``, and
    the ``masked_values`` and ``distinct_values`` of each column.  One pass: the
    masked columns become rows (column, value) beside each other."""
    names = [r["column"] for r in masks.collect()]  # one row for each masked column
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("v")
    counted = (df.select(values).select("v.*").groupBy("column")
               .agg(F.count("*").alias("documents"), F.count("value").alias("masked_values"), F.countDistinct("value").alias("distinct_values")))
    return masks.join(counted, "column").select("column", "mask", "documents", "masked_values", "distinct_values")


def tenant_scope(df: DataFrame, grants: DataFrame, principal: str, tenant_col: str,
                 grant_tenant_col: str = "tenant", access: str = "can_read") -> DataFrame:
    """Rows of ``df`` whose tenant the principal may access (semi join).

    ``grants``: principal, tenant, can_read, can_write.  A principal without
    a grant sees nothing.  Spark broadcasts the allowed tenants below its size
    threshold and shuffles beyond it.
    """
    allowed = (grants.where((F.col("principal") == principal) & F.col(access))
                     .select(F.col(grant_tenant_col).alias("_tenant")).distinct())
    return df.join(allowed, df[tenant_col] == allowed["_tenant"], "left_semi")
