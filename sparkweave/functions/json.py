"""JSON encode/decode with a quarantine split for malformed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Microsecond timestamps: the default writer format keeps milliseconds only.
JSON_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
}

CORRUPT = "_corrupt_record"


def encode_json(*cols: Column | str) -> Column:
    """``to_json(struct(cols))`` with microsecond timestamps."""
    return F.to_json(F.struct(*cols) if cols else F.struct("*"), JSON_OPTIONS)


def decode_json(df: DataFrame, value: str | Column, schema: T.StructType,
                keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parse ``value`` (string or UTF-8 binary) with ``schema``.

    Returns ``(valid, quarantine)``.  ``valid`` has the ``keep`` columns plus
    the schema's fields; missing keys become NULL, extra keys are ignored.
    ``quarantine`` has the ``keep`` columns plus ``raw`` (the undecodable
    text): what is no single JSON object, or has a field of another type.
    """
    keep = keep or []
    vcol = F.col(value) if isinstance(value, str) else value
    text = vcol.cast("string")
    # The parser stops at the end of the first value.  Inside an object and as
    # the only element of an array, whatever follows it makes the text malformed.
    wrapped = F.concat(F.lit('{"v":'), text, F.lit(',"end":true}'))
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    parse_schema = T.StructType([T.StructField("v", schema), T.StructField("end", T.BooleanType()),
                                 T.StructField(CORRUPT, T.StringType())])
    opts = dict(JSON_OPTIONS, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    parsed = df.select(*keep, text.alias("_raw"), F.from_json(wrapped, parse_schema, opts).alias("_p"), alone.alias("_n"))
    good = (F.col(f"_p.{CORRUPT}").isNull() & F.col("_p.v").isNotNull() & F.col("_p.end") & (F.col("_n") == 1))
    good = F.coalesce(good, F.lit(False))
    valid = parsed.where(good).select(*keep, *[F.col(f"_p.v.{f.name}").alias(f.name) for f in schema.fields])
    quarantine = parsed.where(~good).select(*keep, F.col("_raw").alias("raw"))
    return valid, quarantine
