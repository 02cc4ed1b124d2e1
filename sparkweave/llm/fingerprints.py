"""Document fingerprints by content-defined chunking.

A gear hash over the UTF-8 bytes marks boundaries: chunk sizes are normalised
by a stricter mask before the wanted size and a laxer one after it, between a
least and a largest size.  A boundary depends on the 32 bytes before it only,
so text that moves keeps its chunks.  A fingerprint is the set of chunk
digests with the chunks' lengths; containment of two fingerprints is the
length of the chunks in both over the length of the smaller set.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import map_slices, texts

LEAST, WANTED, LARGEST = 16, 64, 256  # bytes of a chunk
STRICT_BITS, LAX_BITS = 7, 5  # of the hash that must be zero before and after the wanted size
#: Ranges of ids a shuffle partition gets on average.
RANGES = 6

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype="u4")


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of their gear value shifted
    by their distance (modulo 2**32), by doubling the window five times."""
    h = _GEAR[np.frombuffer(data, "u1")]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)  # numpy buffers operands that overlap
    return h


def chunk_ends(data: bytes) -> list[int]:
    """End offsets of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(data)
    lax = np.flatnonzero((h >> np.uint32(32 - LAX_BITS)) == 0)
    strict = (h[lax] >> np.uint32(32 - STRICT_BITS)) == 0
    at, flags, ends, start, i = lax.tolist(), strict.tolist(), [], 0, 0
    while start < n:
        low, wanted, high = start + LEAST - 1, start + WANTED - 1, start + LARGEST - 1
        end = min(high, n - 1)
        while i < len(at) and at[i] < low:
            i += 1
        while i < len(at) and at[i] < end:
            if at[i] >= wanted or flags[i]:
                end = at[i]
                break
            i += 1
        start = end + 1
        ends.append(start)
    return ends


def fingerprint(text: str) -> dict[int, int]:
    """Chunk digest -> length; empty for an empty text."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in chunk_ends(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def written(chunks: dict[int, int]) -> str:
    """A fingerprint as text: sorted ``digest.length`` in hexadecimal."""
    return " ".join(f"{d:016x}.{n:x}" for d, n in sorted(chunks.items()))


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share (0 to 1) of the smaller set's length that both have; 1 for two
    empty sets, 0 if one is empty."""
    if not a or not b:
        return float(not a and not b)
    both = sum(n for d, n in a.items() if d in b)
    return both / min(sum(a.values()), sum(b.values()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every row; a null or empty text has the
    empty fingerprint."""

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "fingerprint": [written(fingerprint(x)) for x in b["text"].to_pylist()]}

    return map_slices(texts(docs), run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the beginning of
    ``following`` as there is (code points, rounded down)."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def with_ranges(rows: DataFrame) -> DataFrame:
    """Adds ``range`` (ascending with the id; null ids come first) and ``copy``.

    The highest row of each range is there twice: with ``copy`` 1 it also closes
    the range above, and the highest of all closes the lowest range, so that in
    each range, sorted by falling id, every row is followed by its next.  Ranges
    are cut at quantiles of the ids, ``RANGES`` for each shuffle partition; only
    the cuts and the ranges' highest ids meet in one place."""
    spark = rows.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = np.array(sorted(set(cuts or [])), "i8")

    @F.pandas_udf("int")
    def number(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.fillna(0).to_numpy("i8"))
        return pd.Series(np.where(ids.isna(), -1, at), index=ids.index, dtype="int32")

    placed = rows.withColumn("range", number("doc_id"))
    tops = placed.groupBy("range").agg(F.max("doc_id").alias("top")).orderBy("range").collect()
    above = [(r.range, r.top, tops[(i + 1) % len(tops)].range) for i, r in enumerate(tops)]
    closing = spark.createDataFrame(above, "top_range int, top long, closes int")
    is_top = (F.col("range") == F.col("top_range")) & F.col("doc_id").eqNullSafe(F.col("top"))
    own = F.struct("range", F.lit(0).alias("copy"))
    return (placed.join(F.broadcast(closing), is_top, "left")
            .withColumn("at", F.explode(F.when(F.col("closes").isNull(), F.array(own)).otherwise(
                F.array(own, F.struct(F.col("closes").alias("range"), F.lit(1).alias("copy"))))))
            .select("doc_id", "text", "at.range", "at.copy"))


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, and likenesses.

    The next document is the one with the next smaller id (after the smallest:
    the largest); rows with the same id follow each other by text, and null ids
    come after the smallest.  A null text is empty; an empty text has the empty
    fingerprint, which is like another empty one (1) and unlike all others (0).
    Repeated rows are each reported, extra columns ignored; a table of one row
    is followed by itself, an empty table gives no rows; texts are taken whole."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        waiting = None  # a row whose next hasn't come: (range, id, text, fingerprint)
        for b in batches:
            out = []
            for at, copy, doc, text in zip(*[b[c].to_pylist() for c in ("range", "copy", "doc_id", "text")]):
                if copy and waiting is None:
                    continue  # more rows with the highest id of the range below
                own = fingerprint(text)
                if waiting is not None:
                    _, was, before, chunks = waiting
                    changed = edited(before, text)
                    new = fingerprint(changed)
                    out.append((was, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(chunks),
                                written(new), containment(chunks, new), containment(chunks, own)))
                waiting = None if copy else (at, doc, text, own)
            yield dict(zip(names, zip(*out))) if out else {c: [] for c in names}

    rows = with_ranges(texts(docs))
    dealt = rows.repartition("range").sortWithinPartitions("range", "copy", F.desc_nulls_last("doc_id"), "text")
    return map_slices(dealt, run, schema)
