"""Flatten landed API responses (PRJ-7, PRJ-8, FLT-5).

Both work on a DataFrame that already holds the parsed response struct
(``sources.responses.read_responses``) and use only ``explode`` and
higher-order array functions, so one response never needs to fit anywhere
but in its own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()

USER_SCHEMA = T.StructType([
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("gender", S),
        T.StructField("name", T.StructType([T.StructField(n, S) for n in ("title", "first", "last")])),
        T.StructField("location", T.StructType([
            T.StructField("street", T.StructType([
                T.StructField("number", T.LongType()), T.StructField("name", S)])),
            T.StructField("city", S), T.StructField("state", S),
            T.StructField("country", S), T.StructField("postcode", S),
        ])),
        T.StructField("email", S),
        T.StructField("login", T.StructType([T.StructField(n, S) for n in ("uuid", "username", "password")])),
        T.StructField("dob", T.StructType([T.StructField("date", S)])),
        T.StructField("registered", T.StructType([T.StructField("date", S)])),
        T.StructField("phone", S), T.StructField("cell", S),
        T.StructField("picture", T.StructType([T.StructField(n, S) for n in ("large", "medium", "thumbnail")])),
        T.StructField("nat", S),
    ]))),
])

SEARCH_SCHEMA = T.StructType([
    T.StructField("collection", T.StructType([
        T.StructField("items", T.ArrayType(T.StructType([
            T.StructField("href", S),
            T.StructField("data", T.ArrayType(T.StructType([
                T.StructField("title", S), T.StructField("description", S),
                T.StructField("keywords", T.ArrayType(S)),
            ]))),
            T.StructField("links", T.ArrayType(T.StructType([
                T.StructField("href", S), T.StructField("rel", S)]))),
        ]))),
    ])),
])

# The flat user record, in the order of the relational table.
USER_COLUMNS = [
    ("title", "name.title"), ("first", "name.first"), ("last", "name.last"),
    ("street", None), ("city", "location.city"), ("state", "location.state"),
    ("postcode", "location.postcode"), ("country", "location.country"),
    ("gender", "gender"), ("email", "email"), ("uuid", "login.uuid"),
    ("username", "login.username"), ("password", "login.password"),
    ("phone", "phone"), ("cell", "cell"), ("dob", "dob.date"),
    ("registered", "registered.date"), ("large", "picture.large"),
    ("medium", "picture.medium"), ("thumbnail", "picture.thumbnail"), ("nat", "nat"),
]


def flatten_users(df: DataFrame, results: str = "results", keep: list[str] | None = None) -> DataFrame:
    """One row per user; ``street`` = number + ' ' + name.

    A response without ``results`` yields no rows.  A NULL street number or
    name gives a NULL street (SQL ``concat``).
    """
    keep = keep or []
    u = df.select(*keep, F.explode(F.col(results)).alias("_u"))
    cols = []
    for name, path in USER_COLUMNS:
        if name == "street":
            c = F.concat(F.col("_u.location.street.number").cast("string"), F.lit(" "),
                         F.col("_u.location.street.name"))
        else:
            c = F.col(f"_u.{path}")
        cols.append(c.cast("string").alias(name))
    return u.select(*keep, *cols)


def flatten_search(df: DataFrame, collection: str = "collection", keep: list[str] | None = None) -> DataFrame:
    """One row per search item: item fields without ``data``/``links`` plus
    ``title``, ``description``, ``keywords`` (joined by ', ', '' if absent) and
    ``preview`` (hrefs of links with rel = 'preview').

    An item with empty or missing ``data`` gets NULL title/description; one
    without ``links`` gets an empty preview list.  Other items are unaffected.
    """
    keep = keep or []
    items = df.select(*keep, F.explode(F.col(f"{collection}.items")).alias("_i"))
    item_fields = [f.name for f in items.schema["_i"].dataType.fields if f.name not in ("data", "links")]
    first = F.get(F.col("_i.data"), 0)
    links = F.coalesce(F.col("_i.links"), F.array().cast("array<struct<href:string,rel:string>>"))
    return items.select(
        *keep,
        *[F.col(f"_i.{n}").alias(n) for n in item_fields],
        first.getField("title").alias("title"),
        first.getField("description").alias("description"),
        F.array_join(F.coalesce(first.getField("keywords"), F.array().cast("array<string>")), ", ").alias("keywords"),
        F.transform(F.filter(links, lambda l: l.getField("rel") == "preview"),
                    lambda l: l.getField("href")).alias("preview"),
    )
