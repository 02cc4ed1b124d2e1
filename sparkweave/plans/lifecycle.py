"""Multi-format ETL flow: read -> refine -> write -> read back.

Lazy until the write: Catalyst prunes the scan to the columns the spec keeps
and the refinement runs as one projection inside the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkweave.operators.refine import EtlSpec, refine
from sparkweave.sinks.files import write_refined
from sparkweave.sources.files import read_any


def ingest_refine_write(spark: SparkSession, source: str, spec: EtlSpec, target: str,
                        fmt: str = "parquet", source_fmt: str | None = None,
                        schema: T.StructType | None = None, keep_key: bool = False) -> DataFrame:
    """Run the flow and return the written data as read back from ``target``."""
    src = read_any(spark, source, source_fmt, schema)
    refined = refine(src, spec)
    write_refined(refined, spec, target, fmt, keep_key=keep_key)
    out_schema = refined.drop(spec.key).schema if (spec.key and not keep_key) else refined.schema
    return read_any(spark, target, fmt, out_schema)
