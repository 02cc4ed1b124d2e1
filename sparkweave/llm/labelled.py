"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import texts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, rows: Column | None = None) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1) and ``text`` of at most ``per_class``
    labelled documents of each class (those with the smallest hashes of their
    ids), out of the labels of ``docs`` for which ``rows`` holds.

    Other labels and null ids are left out; of several labels of a document
    the largest counts, of several texts the smallest.  The chosen ids (at most
    2 * ``per_class``) are broadcast, so texts stay where they are read."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if rows is not None:
        known = known.filter(rows)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    order = F.xxhash64("doc_id"), "doc_id"
    chosen = [known.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    found = texts(docs).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
