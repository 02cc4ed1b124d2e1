"""Catalog tables: create, append, merge (SNK-9, SNK-10, SNK-16).

Row-level formats run SQL ``MERGE INTO``; plain file tables get the merged rows
in a new place, so that no folder is read and overwritten at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.operators.upsert import upsert


def create_table_if_absent(spark: SparkSession, name: str, schema: T.StructType | str,
                           provider: str = "parquet", location: str | None = None) -> None:
    """``CREATE TABLE IF NOT EXISTS`` with a fixed schema."""
    ddl = schema if isinstance(schema, str) else ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    loc = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING {provider}{loc}")


def append_to_table(df: DataFrame, name: str) -> None:
    """Append by column name to an existing catalog table.

    v2 catalogs (Iceberg, ...) take ``writeTo(...).append()``; the session
    catalog's file tables refuse it, so they get a by-name ``insertInto``.
    """
    spark = df.sparkSession
    table_cols = spark.table(name).columns
    missing = set(table_cols) - set(df.columns)
    extra = set(df.columns) - set(table_cols)
    if extra:
        raise ValueError(f"columns not in table {name}: {sorted(extra)}")
    schema = spark.table(name).schema
    aligned = df.select(*[F.col(c) if c not in missing else F.lit(None).cast(schema[c].dataType).alias(c)
                          for c in table_cols])
    from pyspark.errors import AnalysisException
    try:
        aligned.writeTo(name).append()
    except AnalysisException:
        aligned.write.insertInto(name)


#: Providers whose tables take row-level SQL ``MERGE``.
ROW_LEVEL = ("delta", "iceberg", "hudi")


def _provider(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where(F.lower("col_name") == "provider").collect()
    return rows[0]["data_type"].lower() if rows else "parquet"


def merge_into_table(df: DataFrame, name: str, key: str | list[str], new_location: str,
                     order: str | list[str] | None = None) -> str:
    """MERGE ``df`` into catalog table ``name`` on ``key``: matched rows are
    replaced, others inserted.  Returns "merge", "swap" or "partitions".

    The catalog names the provider.  Row-level formats run SQL ``MERGE INTO``,
    and its errors are the caller's.  Plain file tables refuse it; the merged
    rows are written to ``new_location`` in the table's own format:

    * an unpartitioned table is then pointed there with ``ALTER TABLE ... SET
      LOCATION`` (readers switch atomically; the old files stay until removed);
    * of a partitioned table, only the partitions that hold a matched row or
      get a new one are merged, and replaced by dynamic partition overwrite;
      those that lost all their rows are dropped.
    """
    from sparkweave.operators.upsert import _keys, check_keys, latest_per_key
    spark = df.sparkSession
    keys = _keys(key)
    check_keys(df, keys, unique=order is None)
    src = latest_per_key(df, keys, order) if order is not None else df
    provider = _provider(spark, name)
    if provider in ROW_LEVEL:
        view = f"_sw_merge_src_{uuid.uuid4().hex[:8]}"
        src.createOrReplaceTempView(view)
        on = " AND ".join(f"t.`{k}` = s.`{k}`" for k in keys)
        try:
            spark.sql(f"MERGE INTO {name} t USING {view} s ON {on} "
                      "WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *")
        finally:
            spark.catalog.dropTempView(view)
        return "merge"
    current = spark.table(name)
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if not parts:
        merged = upsert(current, src, keys, null_keys="ignore").select(*current.columns)
        merged.write.format(provider).mode("errorifexists").save(new_location)
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{new_location}'")
        spark.catalog.refreshTable(name)
        return "swap"
    matched = current.join(src.select(*keys), keys, "left_semi")
    touched = matched.select(*parts).union(src.select(*parts)).distinct().select(*[F.col(p).alias(f"_p_{p}") for p in parts])
    same = [F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in parts]
    merged = upsert(current.join(touched, same, "left_semi"), src, keys, null_keys="ignore").select(*current.columns)
    merged.write.mode("errorifexists").parquet(new_location)
    staged = spark.read.schema(current.schema).parquet(new_location)
    emptied = (matched.select(*parts).distinct().select(*[F.col(p).alias(f"_p_{p}") for p in parts])
               .join(staged, same, "left_anti").collect())  # of partitions, never of rows
    # insertInto heeds the session's setting only, so the overwrite has a session of its own (the catalog is shared).
    own = spark.newSession()
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    own.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    own.read.schema(current.schema).parquet(new_location).write.mode("overwrite").insertInto(name)
    for r in emptied:
        spec = ", ".join(f"`{p}` = " + ("null" if r[f"_p_{p}"] is None else "'" + str(r[f"_p_{p}"]).replace("'", "\\'") + "'") for p in parts)
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({spec})")
    spark.catalog.refreshTable(name)
    return "partitions"
