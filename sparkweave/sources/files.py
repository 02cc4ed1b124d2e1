"""File sources (SRC-1..5, SRC-18).

Readers always accept an explicit schema; inference is opt-in because it
costs an extra pass over the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkweave.functions.json import JSON_OPTIONS

FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".parquet": "parquet"}

CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "nullValue": "\\N",        # NULL; "" is an empty string, and white space stays
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampNTZFormat": JSON_OPTIONS["timestampNTZFormat"],
    "timestampFormat": JSON_OPTIONS["timestampFormat"],
}


def format_of(path: str) -> str:
    """Format from the file suffix; an unknown suffix is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, fmt in FORMATS.items():
        if name.endswith(suffix):
            return fmt
    raise ValueError(f"unknown file extension: {path}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = False, multi_line: bool = False, **options) -> DataFrame:
    """Header CSV, split by size.  ``multi_line=True`` for files whose quoted
    values span lines: those are read whole, one task per file.  An unquoted
    empty value and ``\\N`` are NULL, a quoted empty value is the empty string
    (so a value that is itself ``\\N`` reads as NULL)."""
    r = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).options(**options)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", "true")
    return r.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              multi_line: bool = False, **options) -> DataFrame:
    """NDJSON by default (splittable); ``multi_line=True`` for files holding
    one JSON array or one object each (read whole, one task per file)."""
    r = spark.read.options(**JSON_OPTIONS).option("multiLine", str(multi_line).lower()).options(**options)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_parquet(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan (paths may be globs).  With ``schema`` the scan reads
    exactly those columns; absent columns read as NULL.  A column stored
    with another physical type fails: read with the file's type, then cast."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    return r.parquet(*([path] if isinstance(path, str) else path))


def read_any(spark: SparkSession, path: str, fmt: str | None = None,
             schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Dispatch on ``fmt`` or on the path suffix (csv, json, parquet)."""
    fmt = fmt or format_of(path)
    if fmt == "csv":
        return read_csv(spark, path, schema, **options)
    if fmt == "json":
        return read_json(spark, path, schema, **options)
    if fmt == "parquet":
        return read_parquet(spark, path, schema)
    raise ValueError(f"unsupported format {fmt!r}")
