"""Token counts by joining pre-token counts to per-document frequencies.

The pieces a vocabulary makes of a pre-token are counted once per distinct
pre-token of the corpus.  Documents are then described by how often each
pre-token occurs in them, the counts are joined on and summed; ids are never
made per document.  The most frequent pre-tokens carry nearly all occurrences:
their counts (at most ``HEAVY`` of at most ``HEAVY_BYTES`` bytes, at most 13 MB)
are broadcast and summed where the text is read, so only rare pre-tokens are
shuffled, and no join key is hot.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import CACHE_ENTRIES, held, map_slices, materialise, texts
from sparkweave.llm.pretokens import pieces, pretokens, vocabulary_path

HEAVY, HEAVY_BYTES = 200_000, 64


def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    return held(f"counts-{vocabulary}", lambda: Tokenizer.from_file(vocabulary_path(vocabulary)))


def pretoken_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """``piece``, ``freq`` (occurrences in the corpus) and ``n`` (tokens) of
    every distinct pre-token of all texts."""

    def tally(batches):
        found: Counter = Counter()  # of pieces; cut into pre-tokens when it is full

        def cut() -> dict:
            seen: Counter = Counter()
            for p, n in found.items():
                for w in pretokens(p):
                    seen[w] += n
            found.clear()
            return {"piece": list(seen), "freq": list(seen.values())}

        for b in batches:
            found.update(chain.from_iterable(map(pieces, b["text"].to_pylist())))
            if len(found) > CACHE_ENTRIES:
                yield cut()
        yield cut()

    def count(batches):
        tok = _tokenizer(vocabulary)
        for b in batches:
            made = tok.encode_batch_fast(b["piece"].to_pylist(), add_special_tokens=False)
            yield {"piece": b["piece"], "freq": b["freq"], "n": [len(x.ids) for x in made]}

    corpus = map_slices(texts(docs).select("text"), tally, "piece string, freq long")
    return map_slices(corpus.groupBy("piece").agg(F.sum("freq").alias("freq")), count, "piece string, freq long, n long",
                      holds=f"counts-{vocabulary}")


def _heavy(known: DataFrame) -> dict[str, int]:
    """Tokens of the most frequent pre-tokens: those from the least frequency on
    for which there are at most ``HEAVY``."""
    short = known.filter(F.octet_length("piece") <= HEAVY_BYTES)
    step = F.floor(F.log2("freq") * 4)
    room, least = HEAVY, None
    for r in short.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    return {} if least is None else {r.piece: r.n for r in short.filter(step >= least).select("piece", "n").collect()}


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    Null and empty texts count 0 bytes and tokens; repeated rows and null ids
    are counted row by row; extra columns are ignored; an empty table gives no
    rows.  The special string inside a text is one token."""
    known = materialise(pretoken_counts(docs, vocabulary), "pretoken-counts")
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(known))

    def frequencies(batches):
        counts = heavy.value
        sums = dict(counts)  # and of pieces whose pre-tokens are all in there
        for b in batches:
            row, doc_id, n_bytes, piece, freq, tokens = [], [], [], [], [], []
            for r, doc, x in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), b["text"].to_pylist()):
                parts, total, rare = pieces(x), 0, []
                for p, n in zip(parts, map(sums.get, parts)):
                    if n is None:
                        ws = pretokens(p)
                        ns = list(map(counts.get, ws))
                        if None in ns:
                            rare += [w for w, m in zip(ws, ns) if m is None]
                            n = sum(m for m in ns if m)
                        else:
                            n = sum(ns)
                            if len(sums) < HEAVY + CACHE_ENTRIES and len(p) <= HEAVY_BYTES:
                                sums[p] = n
                    total += n
                seen = Counter(rare)
                row += [r] * (len(seen) + 1)
                doc_id += [doc] + [None] * len(seen)
                n_bytes += [len(x.encode())] + [0] * len(seen)
                piece += [f"\0{r}", *seen]  # the document's own row: any key that spreads
                freq += [0, *seen.values()]
                tokens += [total] + [0] * len(seen)
            yield {"row": row, "doc_id": doc_id, "n_bytes": n_bytes, "piece": piece, "freq": freq, "tokens": tokens}

    rows = texts(docs).withColumn("row", F.monotonically_increasing_id())
    # A row's number is made and used in one pass, so it needs no stable order of the rows.
    spread = map_slices(rows, frequencies, "row long, doc_id long, n_bytes long, piece string, freq long, tokens long")
    total = (spread.join(known.select("piece", "n"), "piece", "left").groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("tokens") + F.col("freq") * F.coalesce("n", F.lit(0))).alias("n_tokens")))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
