"""Messages with unknown keys: one table with the union of them (SRC-7).

The schema is found by one aggregate over *all* messages.  Each task folds the
types of its messages, the folded types are merged as aggregates are (a task
sends one row, whatever it has read), and one parse with the merged schema
follows.  Types merge upwards: whole numbers < doubles < text, and anything
else that differs becomes text; structs merge field by field, arrays by their
elements.  A key that a message lacks is NULL in its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.functions.json import JSON_OPTIONS

_OBJECT = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<")


def _widened(t: T.DataType) -> T.DataType:
    """The column type of a merged message type."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_widened(t.elementType))
    if isinstance(t, (T.DecimalType, T.DoubleType, T.FloatType)):
        return T.DoubleType()
    if isinstance(t, (T.LongType, T.BooleanType)):
        return t
    return T.StringType()  # text, differing types, or nothing but nulls


def merged_type(ddl: str) -> T.DataType:
    """The type named by ``schema_of_variant_agg``."""
    return _widened(T._parse_datatype_string(_OBJECT.sub(lambda m: m[0] if m[0][0] == "`" else "STRUCT<", ddl)))


def _object(text: Column) -> Column:
    """The message as a variant if it is one JSON object and nothing else
    (a key that occurs twice makes it none)."""
    parsed = F.try_parse_json(text)
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.when(alone & F.schema_of_variant(parsed).startswith("OBJECT<"), parsed)


def union_schema(messages: DataFrame, value: str | Column) -> T.StructType:
    """Union of the keys of all messages, with their merged types."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    found = messages.agg(F.schema_of_variant_agg(_object(text))).first()[0]
    merged = merged_type(found)
    return merged if isinstance(merged, T.StructType) else T.StructType([])


def _names(schema: T.StructType, taken: list[str]) -> list[str]:
    """Column names of the keys: one that is taken, but for upper and lower case,
    gets a number."""
    used, out = {c.lower() for c in taken}, []
    for f in schema.fields:
        name, i = f.name, 2
        while name.lower() in used:
            name, i = f"{f.name}_{i}", i + 1
        used.add(name.lower())
        out.append(name)
    return out


def decode_union(messages: DataFrame, value: str, keep: list[str] | None = None,
                 schema: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantine)``: the ``keep`` columns with a column for every key of
    any message, and the ``keep`` columns with ``raw``, the text of what is no
    JSON object.  A NULL message is in the quarantine.  ``schema`` saves the pass
    over the messages that finds it.  No messages, or only empty objects, give the
    ``keep`` columns alone."""
    keep = list(keep or [])
    text = F.col(value).cast("string")
    schema = union_schema(messages, value) if schema is None else schema
    good = _object(text).isNotNull()
    quarantine = messages.where(~good).select(*keep, text.alias("raw"))
    rows = messages.where(good)
    if not schema.fields:
        return rows.select(*keep), quarantine
    parsed = F.from_json(text, schema, JSON_OPTIONS)
    # By place, not by name: keys may differ in case only, or hold dots.
    decoded = rows.select(*keep, F.inline(F.array(parsed)))
    return decoded.toDF(*keep, *_names(schema, keep)), quarantine
