"""Personal data in texts: patterns propose, checksums confirm, context scores.

Everything is DataFrame expressions.  Per kind, ``regexp_extract_all`` gives
the matches and ``split`` the text between them; running sums of their lengths
give positions in code points.  Only matches are shuffled, never texts.

Patterns are written so that Java matches them in linear time and without
recursion (possessive repetition where nothing that follows could make it give
back, and starts only where a run starts or the match before ended); they find
what the plain forms beside them find.

Score of a span: its kind's prior, raised by a word of its kind's context in
the 40 characters before it and lowered by a contrary one.  The four base kinds
stay whatever their score; added kinds stay from ``KEEP`` on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm.common import by_position, materialise, texts

KEEP, STEP, NEAR = 0.5, 0.3, 40


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _length_between(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass Luhn's check."""
    digits = F.transform(F.split(F.reverse(_digits(match)), ""), lambda d: d.cast("int"))
    return F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))),
        F.lit(0), lambda a, d: a + d) % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether an account number (two letters, two check digits, the rest)
    leaves 1 modulo 97 with its first four characters moved to the end."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97)) == 1


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (x.cast("decimal(38,0)") <= 255))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    prior: float
    context: str = ""
    contrary: str = ""
    base: bool = True


#: In the order in which spans with the same start are listed.
KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.9, "mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.6, "ip|address|host|server", "version|section|release"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[0-9]|[\x20-](?=[0-9]))++",
         lambda m: _length_between(_digits(m), 14, 19) & luhn(m), 0.8, "card|visa|credit|payment", "order|serial"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: _length_between(_digits(m), 10, 15), 0.6,
         "phone|call|tel|mobile|fax", "sum|total"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
         mod_97, 0.9, "iban|account|bank", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda m: F.lit(True), 0.3, "ssn|social security", "part|order", base=False),
)


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), kind + 1)


def _matches(text: Column, order: int, kind: Kind) -> Column:
    """Array of a kind's matches, each with the length and end of the text since the match before."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.when(F.size(found) > 0, F.split(text, kind.pattern, -1))
    return F.when(F.size(found) > 0, F.transform(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        lambda x, i: F.struct(F.lit(order).alias("kind"), i.alias("nth"), x["m"].alias("match"),
                              F.length(x["b"]).cast("long").alias("gap"), F.lower(F.right(x["b"], F.lit(NEAR))).alias("before"))))


def _scored(match: Column, before: Column) -> tuple[Column, Column]:
    """(valid, score) of a match by its kind."""
    valid, score = F.lit(False), F.lit(0.0)
    for i, k in enumerate(KINDS):
        near = lambda words: before.rlike(rf"\b(?:{words})") if words else F.lit(False)  # noqa: E731, B023
        own = F.lit(k.prior) + F.when(near(k.context), STEP).otherwise(0) - F.when(near(k.contrary), STEP).otherwise(0)
        valid, score = F.when(F.col("kind") == i, k.valid(match)).otherwise(valid), F.when(F.col("kind") == i, own).otherwise(score)
    return valid, F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 2)


def find_spans(rows: DataFrame, *keep: str) -> DataFrame:
    """``row``, ``kind`` (number), ``start``, ``end`` (code points, end
    exclusive) and ``score`` of the spans in the ``text`` of each ``row``, and
    the columns ``keep``; a row without matches is there once, without a kind."""
    kind = "array<struct<kind:int,nth:int,match:string,gap:bigint,before:string>>"
    found = F.concat(*[F.coalesce(_matches(F.col("text"), i, k).cast(kind), F.array().cast(kind)) for i, k in enumerate(KINDS)])
    each = rows.select("row", *keep, F.explode_outer(found).alias("s")).select("row", *keep, "s.*")
    order = Window.partitionBy("row", "kind").orderBy("nth")
    width = F.length("match").cast("long")
    each = each.withColumn("end", F.sum(F.col("gap") + width).over(order)).withColumn("start", F.col("end") - width)
    valid, score = _scored(F.col("match"), F.col("before"))
    base = F.col("kind").isin([i for i, k in enumerate(KINDS) if k.base])
    stays = F.coalesce(valid & (base | (score >= KEEP)), F.lit(False))
    return (each.withColumn("score", score).withColumn("kind", F.when(stays, F.col("kind")))
            .select("row", *keep, "kind", "start", "end", "score"))




def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", _name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every row.

    Null and empty texts have none (the digest is that of no bytes).  Repeated
    rows and null ids are searched row by row; extra columns are ignored; an
    empty table gives no rows.  Texts are searched whole."""
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "score"))
    joined = (find_spans(rows, "doc_id").groupBy("row")
              .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("s")))
    s = F.col("s")
    n = lambda i: F.size(F.filter(s, lambda x: x["kind"] == i)).cast("long")
    base = F.filter(s, lambda x: x["kind"].isin([i for i, k in enumerate(KINDS) if k.base]))
    return joined.select("doc_id", *[n(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base],
                         F.sha2(_written(base), 256).alias("base_sha256"), _written(s).alias("spans"),
                         F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets
    (overlapping spans by that of the first) and ``n_chars`` counted anew where
    the text changed.  All rows and columns stay, whatever they are called; a null
    text stays null."""
    return by_position(docs, _redacted, "text", "n_chars")


def _redacted(docs: DataFrame) -> DataFrame:
    rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    spans = find_spans(rows.select(F.col("__row").alias("row"), F.coalesce("text", F.lit("")).alias("text"))).filter("kind IS NOT NULL")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    listed = spans.groupBy(F.col("row").alias("__r")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "seen"))).alias("__s"))
    cut = lambda at, n: F.substring(F.col("text"), (at + 1).cast("int"), n.cast("int"))
    parts = F.transform("__s", lambda s: F.when(s["start"] >= s["seen"], F.concat(
        cut(s["seen"], s["start"] - s["seen"]), F.lit("["), F.upper(_name(s["kind"])), F.lit("]"))).otherwise(F.lit("")))
    end = F.array_max(F.transform("__s", lambda s: s["end"]))
    clean = F.concat(F.array_join(parts, ""), cut(end, F.length("text") - end))
    joined = rows.join(listed, F.col("__row") == F.col("__r"), "left")
    found = F.col("__s").isNotNull()
    out = joined.withColumn("__clean", F.when(found, clean))
    replaced = {"text": F.coalesce("__clean", "text")}
    if "n_chars" in docs.columns:
        replaced["n_chars"] = F.when(found, F.length("__clean").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[replaced.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
