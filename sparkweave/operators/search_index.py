"""Indexed substring search: a trigram inverted index (FLT-4).

Every text, in lower case, gives its distinct trigrams of code points.  A task
puts the ids of some thousand texts together by gram, and those lists are
written once, in folders by a hash of the gram and sorted by gram inside them,
beside the number of texts of each gram.  A question reads the folders of its
rarest grams alone, keeps the ids that have all of those and looks for the whole
term in those texts only, so the answer is exact.  Terms of fewer than three
code points have no gram and are looked for in all texts.

New texts are added as a segment of their own; nothing written changes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.operators.documents import search_terms

GRAM, BUCKETS, MOST_GRAMS = 3, 256, 4
#: Texts, and bytes on average, that a task puts together at a time.
TEXTS, NBYTES = 8192, 8 << 20


def grams(text: str) -> list[str]:
    """Distinct trigrams of a lower-case text; none of a shorter one."""
    return sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})


def text_lists(texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(grams, number of texts of each, places of those texts gram by gram)."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "u4")
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    base, n = len(alphabet), len(texts)
    if n > 1 and base ** GRAM * n >= 2 ** 63:  # a gram and a text are one number
        half = n // 2
        yield from text_lists(texts[:half])
        for names, count, place in text_lists(texts[half:]):
            yield names, count, place + half
        return
    if len(points) < GRAM:
        return
    rank = np.zeros(0x110000, "i8")
    rank[alphabet] = np.arange(base)
    letter, text = rank[points], np.repeat(np.arange(n), size)
    whole = text[:1 - GRAM] == text[GRAM - 1:]
    key = ((letter[:-2] * base + letter[1:-1]) * base + letter[2:])[whole] * n + text[:1 - GRAM][whole]
    if not len(key):
        return
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])]
    gram = key // n
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    code = gram[first]
    letters = alphabet[np.stack([code // (base * base), code // base % base, code % base], axis=1)]
    names = letters.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    yield [names[i:i + GRAM] for i in range(0, len(names), GRAM)], np.diff(np.append(first, len(key))), key - gram * n


def lists(rows: DataFrame) -> DataFrame:
    """``gram``, ``n`` and ``ids`` (of n texts) of some texts each, of rows with
    ``id`` and lower-case ``text`` in UTF-8."""
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(TEXTS, batch.num_rows * NBYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                # Bytes that are no UTF-8 give grams that no term has.
                for names, n, place in text_lists([x.decode("utf-8", "replace") for x in b["text"].to_pylist()]):
                    ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), b["id"].take(pa.array(place)))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n, pa.int64()), ids], names=["gram", "n", "ids"])

    return rows.mapInArrow(run, schema)


class SearchIndex:
    """An index below ``root`` of the texts of a table with the key ``id_col``.
    The number of folders is that of the first call."""

    def __init__(self, spark: SparkSession, root: str, id_col: str, text_col: str = "text", buckets: int = BUCKETS):
        self.spark, self.root, self.id_col, self.text_col = spark, root.rstrip("/"), id_col, text_col
        stored = fs.read_text(spark, f"{self.root}/_buckets")
        if stored is None:
            fs.write_text(spark, f"{self.root}/_buckets", str(buckets))
        self.buckets = int(stored or buckets)

    def _bucket(self, gram: str) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int").alias("bucket")

    def segments(self) -> list[int]:
        names = [n for n in fs.list_names(self.spark, self.root) if n.startswith("segment=")]
        return sorted(int(n.split("=")[1]) for n in names if fs.exists(self.spark, f"{self.root}/{n}/grams/_SUCCESS"))

    def add(self, rows: DataFrame) -> int:
        """Index more rows (NULL texts and ids have nothing to find); returns the
        segment's number.  An add that fails leaves no segment."""
        number = max(self.segments(), default=-1) + 1
        base = f"{self.root}/segment={number}"
        given = rows.where(F.col(self.id_col).isNotNull() & F.col(self.text_col).isNotNull())
        found = lists(given.select(F.col(self.id_col).alias("id"), F.lower(self.text_col).cast("binary").alias("text"))).select("*", self._bucket("gram"))
        # A common gram (a third of all texts) goes to as many tasks as there are for each folder.
        share = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        (found.repartition("bucket", F.pmod(F.xxhash64("ids"), F.lit(share))).sortWithinPartitions("bucket", "gram")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/postings"))
        written = self.spark.read.schema(found.schema).parquet(f"{base}/postings")
        counts = written.groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
        counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/grams")
        return number

    def _read(self, kind: str, buckets: list[int]) -> DataFrame | None:
        """Postings or counts of some folders, of all segments."""
        parts = []
        for s in self.segments():
            base = f"{self.root}/segment={s}/{kind}"
            there = set(fs.list_names(self.spark, base))
            here = [f"{base}/bucket={b}" for b in buckets if f"bucket={b}" in there]
            if here:
                parts.append(self.spark.read.option("basePath", base).parquet(*here))
        return reduce(DataFrame.unionByName, parts) if parts else None

    def rarest(self, terms: list[str]) -> dict[str, list[tuple[str, int]] | None]:
        """By term, in lower case, the (gram, folder) that are read, rarest first;
        None if one of its grams is in no text; empty if it has no grams."""
        asked = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.lower("term").alias("term")).distinct().collect()
        parts = [(r.term, g) for r in asked for g in grams(r.term) or [None]]
        pairs = self.spark.createDataFrame(parts, "term string, gram string").select("*", self._bucket("gram")).collect()  # of the question
        counts = self._read("grams", sorted({r.bucket for r in pairs if r.gram is not None}))
        names = sorted({r.gram for r in pairs if r.gram is not None})
        n: dict[str, int] = {}
        if counts is not None:
            n = {r.gram: r.n for r in counts.where(F.col("gram").isin(names)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        out: dict[str, list[tuple[str, int]] | None] = {}
        for term in sorted({r.term for r in pairs}):
            mine = [(r.gram, r.bucket) for r in pairs if r.term == term and r.gram is not None]
            out[term] = sorted(mine, key=lambda p: (n[p[0]], p[0]))[:MOST_GRAMS] if all(g in n for g, _ in mine) else None
        return out

    def candidates(self, read: dict[str, list[tuple[str, int]]]) -> DataFrame | None:
        """``term`` and ``id`` of the texts that hold all the grams that are read."""
        postings = self._read("postings", sorted({b for pairs in read.values() for _, b in pairs}))
        if postings is None:
            return None
        rows = [(t, g, 1 << i, (1 << len(pairs)) - 1) for t, pairs in read.items() for i, (g, _) in enumerate(pairs)]
        wanted = self.spark.createDataFrame(rows, "term string, _gram string, _bit int, _all int")  # of the question
        here = postings.where(F.col("gram").isin(sorted({g for _, g, *_ in rows})))
        return (here.join(F.broadcast(wanted), here["gram"] == wanted["_gram"]).select("term", "_bit", "_all", F.explode("ids").alias("id"))
                .groupBy("term", "id").agg(F.bit_or("_bit").alias("_has"), F.max("_all").alias("_all")).where("_has = _all").select("term", "id"))

    def search(self, rows: DataFrame, terms: list[str], keep: list[str] | None = None) -> DataFrame:
        """As ``documents.search_terms`` over the indexed rows: one row for each row
        and term that its text contains in any case, with a ``term`` column."""
        keep = keep or [c for c in rows.columns if c != self.text_col]
        read = self.rarest(terms)
        short = [t for t, pairs in read.items() if pairs == []]
        found = search_terms(rows, short, self.text_col, keep) if short else None
        ids = self.candidates({t: pairs for t, pairs in read.items() if pairs})
        if ids is not None:
            ids = ids.select(F.col("term").alias("_term"), F.col("id").alias("_id"))
            lower = rows.select(*keep, F.col(self.id_col).alias("_key"), F.lower(self.text_col).alias("_lower"))  # once a row
            met = lower.join(ids, lower["_key"] == ids["_id"]).where(F.col("_lower").contains(F.col("_term")))
            met = met.select(*keep, F.col("_term").alias("term"))
            found = met if found is None else found.unionByName(met)
        return found if found is not None else rows.limit(0).select(*keep, F.lit("").alias("term"))

    def files_read(self, term: str) -> tuple[int, int]:
        """(files of postings that a question reads, all of them)."""
        everything = sum(len(self.spark.read.parquet(f"{self.root}/segment={s}/postings").inputFiles()) for s in self.segments())
        read = next(iter(self.rarest([term]).values()))
        postings = self._read("postings", sorted({b for _, b in read})) if read else None
        return (len(postings.inputFiles()) if postings is not None else 0), everything
