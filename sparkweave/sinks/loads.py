"""Tables that grow by loads (SNK-11..17, SRC-11, SET-1, SET-2, STR-4).

A load is one write of Spark's own writer into a folder of its own,
``<root>/load=<number>``; a load that is run again under its number overwrites
itself, so a replayed micro-batch adds nothing.  A load counts once its writer
has committed it; nothing written is ever changed.

* append: one more load.  Columns may be new and types wider; all loads are read
  with the merged schema, each column cast to its widest type.
* keyed writes (insert-or-replace, merge): one more load, too.  Readers take each
  key's row of the last load, an aggregate that is combined in the tasks before
  the shuffle; ``compact`` folds the loads so far into a base.

Where a table format with a catalog is configured, its own MERGE does this job
(``sinks.tables.merge_into_table``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.operators.upsert import check_keys, latest_per_key
from sparkweave.sinks.files import write_any
from sparkweave.sources.files import read_any

LOAD = "_load"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def wider_type(a: T.DataType, b: T.DataType, where: str = "") -> T.DataType:
    """The type that holds all values of both; an error if there is none."""
    if a == b:
        return a
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merge_schemas(a, b, where)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider_type(a.elementType, b.elementType, f"{where}[]"), a.containsNull or b.containsNull)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType) and a.keyType == b.keyType:
        return T.MapType(a.keyType, wider_type(a.valueType, b.valueType, f"{where}{{}}"), a.valueContainsNull or b.valueContainsNull)
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: [isinstance(t, k) for k in _WHOLE].index(True))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale, whole = max(a.scale, b.scale), max(a.precision - a.scale, b.precision - b.scale)
        if scale + whole <= 38:
            return T.DecimalType(scale + whole, scale)
    kinds = {type(a), type(b)}
    if kinds <= {T.FloatType, T.DoubleType, *_WHOLE[:3]} and kinds & {T.FloatType, T.DoubleType}:
        return T.DoubleType()
    if kinds == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    raise ValueError(f"column {where!r}: {a.simpleString()} and {b.simpleString()} have no common wider type")


def merge_schemas(a: T.StructType, b: T.StructType, where: str = "") -> T.StructType:
    """Columns of both, in order; those in both with the wider type."""
    known = {f.name: f for f in b.fields}
    inside = lambda name: f"{where}.{name}" if where else name
    fields = [T.StructField(f.name, wider_type(f.dataType, known[f.name].dataType, inside(f.name)) if f.name in known else f.dataType)
              for f in a.fields]
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in b.fields if f.name not in set(a.names)])


def aligned(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` as a wider type, field by field inside structs, arrays and maps."""
    if have == want:
        return c
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        known = {f.name: f.dataType for f in have.fields}
        fields = [(aligned(c.getField(f.name), known[f.name], f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(c, lambda x: aligned(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType) and isinstance(have, T.MapType):
        return F.transform_values(c, lambda _, v: aligned(v, have.valueType, want.valueType))
    return c.cast(want)


def loads(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the loads that are written whole, in order."""
    names = [n for n in fs.list_names(spark, root) if n.startswith("load=")]
    return sorted(int(n.split("=")[1]) for n in names if fs.exists(spark, f"{root}/{n}/_SUCCESS"))


def _base(spark: SparkSession, root: str) -> int:
    """The last load folded into the newest base; -1 if there is none."""
    names = [n for n in fs.list_names(spark, root) if n.startswith("upto=")]
    return max((int(n.split("=")[1]) for n in names if fs.exists(spark, f"{root}/{n}/_SUCCESS")), default=-1)


def next_load(spark: SparkSession, root: str) -> int:
    """The number after the last load (one writer at a time; streams use their
    batch ids instead)."""
    return max([_base(spark, root), *loads(spark, root)]) + 1


def _folders(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    base = _base(spark, root)
    first = [(base, f"{root}/upto={base}")] if base >= 0 else []
    return first + [(n, f"{root}/load={n}") for n in loads(spark, root) if n > base]


def append_load(df: DataFrame, root: str, load: int | None = None, fmt: str = "parquet") -> int:
    """Append rows as one load; types that don't merge with those of the table
    are refused before anything is written."""
    spark, root = df.sparkSession, root.rstrip("/")
    number = next_load(spark, root) if load is None else load
    if fmt == "parquet":
        stored = table_schema(spark, root)
        if stored is not None:
            merge_schemas(stored, df.schema)
    write_any(df, f"{root}/load={number}", fmt, mode="overwrite")
    return number


def table_schema(spark: SparkSession, root: str) -> T.StructType | None:
    """Merged schema of the loads of a Parquet table; None without loads."""
    found = [spark.read.parquet(path).schema for _, path in _folders(spark, root.rstrip("/"))]
    return reduce(merge_schemas, found) if found else None


def read_loads(spark: SparkSession, root: str, fmt: str = "parquet", schema: T.StructType | None = None, numbered: bool = False) -> DataFrame:
    """All rows of all loads; with ``numbered``, their load as ``_load``.

    A table without loads reads as an empty frame with ``schema``.  Text formats
    need the schema of their rows; loads that lack some of its columns (CSV: at
    the end) have NULL there."""
    root = root.rstrip("/")
    folders = _folders(spark, root)
    if not folders:
        if schema is None:
            raise FileNotFoundError(f"no load in {root}")
        empty = spark.createDataFrame([], schema)
        return empty.withColumn(LOAD, F.lit(0).cast("long")) if numbered else empty
    if fmt == "parquet":
        own = [(n, path, spark.read.parquet(path).schema) for n, path in folders]
        merged = reduce(merge_schemas, [s for _, _, s in own])
    else:
        own, merged = [(n, path, schema) for n, path in folders], schema
    frames = []
    for n, path, s in own:
        rows = read_any(spark, path, fmt, s, multi_line=True) if fmt == "csv" else read_any(spark, path, fmt, s)
        known = {f.name: f.dataType for f in rows.schema.fields}
        casts = [(aligned(F.col(f"`{f.name}`"), known[f.name], f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in merged.fields]
        frames.append(rows.select(*casts, *([F.lit(n).cast("long").alias(LOAD)] if numbered else [])))
    return reduce(DataFrame.union, frames)


def upsert_load(df: DataFrame, root: str, key: str | list[str], order: str | list[str] | None = None, load: int | None = None) -> int:
    """Insert-or-replace by key: whole rows replace those with the same key.

    With ``order`` the latest row of a key counts; without, a key that occurs
    twice is refused.  A NULL in a key is refused."""
    check_keys(df, key, unique=order is None)
    return append_load(latest_per_key(df, key, order) if order is not None else df, root, load)


def read_latest(spark: SparkSession, root: str, key: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """The table as its keyed loads leave it: each key's row of the last load."""
    rows = read_loads(spark, root, schema=schema, numbered=True)
    return latest_per_key(rows, key, LOAD).drop(LOAD)


def lookup(spark: SparkSession, root: str, key: str, value: object, schema: T.StructType | None = None) -> DataFrame:
    """The row of one key; the equality is pushed into the scans of all loads."""
    rows = read_loads(spark, root, schema=schema, numbered=True).where(F.col(key) == F.lit(value))
    return latest_per_key(rows, key, LOAD).drop(LOAD)


def compact(spark: SparkSession, root: str, key: str | list[str] | None = None) -> int | None:
    """Fold all loads into a new base (by key, if the table has one); returns its
    last load.  Older folders stay until nothing reads them."""
    root = root.rstrip("/")
    numbers = loads(spark, root)
    if not numbers or numbers[-1] <= _base(spark, root):
        return None
    rows = read_latest(spark, root, key) if key is not None else read_loads(spark, root)
    rows.write.mode("overwrite").parquet(f"{root}/upto={numbers[-1]}")
    return numbers[-1]
