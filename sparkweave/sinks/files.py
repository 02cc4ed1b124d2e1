"""File sinks (SNK-1..5).

JSON is always written as one object per line (splittable).  A single JSON
array per dataset would need the whole dataset in one task, so it is not
offered; ``sources.files.read_json(multi_line=True)`` still reads arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkweave.functions.json import JSON_OPTIONS
from sparkweave.operators.refine import EtlSpec
from sparkweave.sources.files import CSV_OPTIONS

FORMATS = ("csv", "json", "parquet")

# Content type of each output format.
CONTENT_TYPES = {"csv": "text/csv", "json": "application/json", "parquet": "application/octet-stream"}


def write_any(df: DataFrame, path: str, fmt: str, mode: str = "overwrite",
              partition_by: list[str] | None = None, **options) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; expected one of {FORMATS}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).options(**options).csv(path)
    elif fmt == "json":
        w.options(**JSON_OPTIONS).options(**options).json(path)
    else:
        w.options(**options).parquet(path)


def put_object(df: DataFrame, bucket: str, name: str, content_type: str, mode: str = "overwrite") -> str:
    """Write ``df`` as ``<bucket>/<name>.<suffix>`` in the format named by a
    content type; unknown content types are rejected.  Missing buckets
    (folders) are created by the writer.  Returns the written path."""
    by_type = {v: k for k, v in CONTENT_TYPES.items()}
    if content_type not in by_type:
        raise ValueError(f"Unsupported content type: {content_type}")
    fmt = by_type[content_type]
    path = f"{bucket.rstrip('/')}/{name}.{fmt}"
    write_any(df, path, fmt, mode=mode)
    return path


def choose_output(refined: DataFrame, source: DataFrame) -> DataFrame:
    """The refined frame if it has rows, else the source (one-row probe)."""
    return refined if not refined.isEmpty() else source


def write_refined(df: DataFrame, spec: EtlSpec, path: str, fmt: str, keep_key: bool = False,
                  mode: str = "overwrite") -> None:
    """Write a refined frame; the key column is not stored unless ``keep_key``."""
    out = df.drop(spec.key) if (spec.key and not keep_key) else df
    write_any(out, path, fmt, mode=mode)
