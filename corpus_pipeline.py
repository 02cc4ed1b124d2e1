"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread.

Quality classifier (rejected documents go), toxicity (rejected documents go),
near-duplicates (one document of each group stays), personal data (spans are
replaced by their kind), packing (the result: the pieces of all documents and
their places in sequences).  Every stage works on all that the one before kept
and returns the columns of documents, but the last.

Nulls and empty texts are documents like others; repeated rows of a document
are one group of near-duplicates, of which one stays; an empty table stays one.
More columns of the documents are kept by all stages but the last, whatever they
are called.  ``run`` removes what a stage wrote on its way, and the stage before
it, as soon as the stage's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm import minhash_dedup, packing, pii, quality, toxicity
from sparkweave.llm.common import by_position, discard, fold, materialise, positioned, scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    size = {"size_class": quality.size_class()}

    def keep(d: DataFrame) -> DataFrame:
        known = d.select("doc_id", "text", "n_chars").withColumns(size)
        machine = quality.train(known, table(spark, sf_dir, "labels"), rows=fold("doc_id", 3) != 1, metadata=tuple(size))
        return quality.accepted(d, machine, size)

    return by_position(docs, keep, "doc_id", "text", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon accepts."""
    def keep(d: DataFrame) -> DataFrame:
        return toxicity.accepted(d, toxicity.learn(d, table(spark, sf_dir, "labels"), rows=fold("doc_id", 5) != 0))

    return by_position(docs, keep, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return minhash_dedup.representatives(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their personal data."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack_documents(positioned(docs, "doc_id", "text"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL cannot express the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    kept: list[DataFrame] = []
    for name, stage in STAGES:
        with scratch(spark, kept):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        if len(kept) > 1:
            discard(kept.pop(0))
    return docs
