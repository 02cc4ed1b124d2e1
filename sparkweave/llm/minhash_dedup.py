"""Near-duplicate documents by SetSketch registers.

1. Every text gives the set of its word shingles (64-bit hashes), an exact
   digest of the set, and a SetSketch: register i holds
   ``floor(1 - log_b(h_i))`` cut to 16 bits, where h_i is the minimum over the
   set of exponentially distributed hash values.  Registers of two sets merge
   by their maximum, and agree the likelier the more similar the sets are.
2. Texts with the same set form a class (an aggregate, combined in the tasks);
   from here on there is one row a class, so copies cost nothing more.
3. Bands of registers are bucket keys.  Every class is tied to the smallest of
   each of its buckets; connected classes are a candidate cluster.  Two sets at
   the threshold miss each other in all bands with a probability of about 1e-5.
4. A cluster is cut into blocks of about ``BLOCK``; each pair of blocks is one
   group of rows.  In it, pairs are taken by falling estimate (the joint
   likelihood of how many registers are larger, smaller and equal, given both
   set sizes); pairs already connected are skipped, pairs whose likelihood
   excludes the threshold are dropped, all others are compared on full sets.
   Only links that connect something new leave the task: no group emits its
   pairs.
5. Components of those links, and of each the smallest document, are the result.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import by_position, discard, map_slices, materialise, runs, texts, word_hash, words
from sparkweave.llm.components import Forest, components

SHINGLE, THRESHOLD = 5, 80  # words; per cent
BASE, RATE, LIMIT = 1.001, 20.0, 65_535  # of the registers
ROWS, BANDS = 7, 48
BLOCK = 128
#: Log likelihood by which an estimate may exceed the threshold's (5 sigma).
MARGIN = 12.5

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")


def _multipliers(n: int) -> np.ndarray:
    """Odd 32-bit multipliers, one a register."""
    return np.random.default_rng(7).integers(0, 1 << 31, n, dtype="u4") * np.uint32(2) + np.uint32(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[3]
    return (h ^ (h >> np.uint64(29))) * _MIX[0]


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the
    whole sequence; without words, empty."""
    ws = words(text)
    h = np.fromiter(map(word_hash, ws), "u8", len(ws))
    n = min(k, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, "u8")
    for i in range(n):
        out = _mixed(out + h[i:len(h) - n + 1 + i] * _MIX[1])
    return np.unique(out)


def registers(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """SetSketch of a set that isn't empty."""
    low = (shingles >> np.uint64(32)).astype("u4")
    least = np.full(len(multipliers), 0xFFFFFFFF, "u4")
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[at:at + 1024, None] * multipliers).min(axis=0), out=least)
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, LIMIT).astype("<u2")


def likelihood(more: np.ndarray, less: np.ndarray, equal: np.ndarray, share: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity, given how many registers of A are larger,
    smaller and equal, and A's share of the sum of both set sizes.  A register
    of A is larger if A's own part holds the minimum by more than rounding."""
    def tail(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    p, q = tail(share - (1 - share) * jaccard), tail((1 - share) - share * jaccard)
    rest = np.maximum(1 - p - q, 1e-12)
    return more * np.log(np.maximum(p, 1e-12)) + less * np.log(np.maximum(q, 1e-12)) + equal * np.log(rest)


def plausible(regs_a: np.ndarray, n_a: int, regs_b: np.ndarray, n_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(may reach the threshold, estimate) of one set against many."""
    more, less = (regs_a > regs_b).sum(axis=1), (regs_a < regs_b).sum(axis=1)
    equal = regs_b.shape[1] - more - less
    share = n_a / (n_a + n_b)
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)  # no similarity is larger
    grid = np.linspace(0.02, 1, 50)[:, None] * top
    at = likelihood(more, less, equal, share, grid)
    best = at.argmax(axis=0)
    estimate = grid[best, np.arange(len(n_b))]
    there = likelihood(more, less, equal, share, np.full(len(n_b), threshold))
    return (top >= threshold) & ((estimate >= threshold) | (at.max(axis=0) - there <= MARGIN)), estimate


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Exact test on sorted sets: 100 * intersection >= threshold * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _text_key() -> Column:
    """By which a text is found again, with its id (both may repeat, or be null)."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sketch(docs: DataFrame, k: int = SHINGLE, row: str | None = None) -> DataFrame:
    """``row`` (the column named, or a number), ``doc_id``, ``text_key``,
    ``n_shingles``, ``digest`` of the set and ``registers``."""
    multipliers = _multipliers(ROWS * BANDS)

    def run(batches):
        for b in batches:
            sets = [shingle_set(x, k) for x in b["text"].to_pylist()]
            yield {"row": b["row"], "doc_id": b["doc_id"], "text_key": b["text_key"], "n_shingles": [len(s) for s in sets],
                   "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                   "registers": [registers(s, multipliers).tobytes() if len(s) else None for s in sets]}

    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _text_key().alias("text_key"), number.alias("row"))
    return map_slices(rows, run, "row long, doc_id long, text_key long, n_shingles long, digest binary, registers binary")


def _links_of_blocks(k: int, threshold: int):
    def run(batches):
        for g in runs(batches, ("cluster", "i", "j")):
            nodes: dict[int, tuple] = {}
            for node, digest, block, regs, text in zip(g["node"], g["digest"], g["block"], g["registers"], g["text"]):
                if node not in nodes:  # repeated rows come with the same text
                    found = shingle_set(text or "", k)
                    if len(found) and xxhash.xxh3_128_digest(found.tobytes()) == digest:
                        nodes[node] = (block, regs, found)
            ids = sorted(nodes)
            block = np.array([nodes[x][0] for x in ids])
            regs = np.array([np.frombuffer(nodes[x][1], "<u2") for x in ids]).reshape(len(ids), -1)
            sets = [nodes[x][2] for x in ids]
            size = np.array([len(s) for s in sets])
            across, pairs = g["i"][0] != g["j"][0], []
            for x in range(1, len(ids)):
                before = np.flatnonzero(block[:x] != block[x]) if across else np.arange(x)
                if len(before):
                    may, estimate = plausible(regs[x], size[x], regs[before], size[before], threshold / 100)
                    pairs += [(-e, x, y) for e, y in zip(estimate[may].tolist(), before[may].tolist())]
            forest, links = Forest(), []
            for _, x, y in sorted(pairs):
                if forest.find(x) != forest.find(y) and similar(sets[x], sets[y], threshold):
                    forest.union(x, y)
                    links.append((ids[x], ids[y]))
            yield {"u": [a for a, _ in links], "v": [b for _, b in links]}

    return run


def _labelled(docs: DataFrame, rows: DataFrame, k: int, threshold: int) -> DataFrame:
    """``digest``, ``node`` (the class's first row), ``root`` (the component's
    smallest node) and ``component_id`` of every class of the sketched rows."""
    classes = materialise(
        rows.filter("n_shingles > 0").groupBy("digest")
        .agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.min_by("doc_id", "row").alias("doc_id"),
             F.min_by("text_key", "row").alias("text_key"), F.min_by("registers", "row").alias("registers"), F.count("*").alias("copies")), "classes")

    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(
        i, F.col("registers").substr(i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    bands = classes.select("node", F.explode(bucket).alias("bucket"))
    first = bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last")
    tied = bands.join(first, "bucket").filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    tied_to = components(tied)
    clusters = tied_to.union(tied_to.select("component", "component").distinct()).withColumnRenamed("component", "cluster")
    blocks = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))

    members = (clusters.join(blocks, "cluster").join(classes.select("node", "doc_id", "text_key", "digest", "registers"), "node")
               .withColumn("block", F.pmod(F.xxhash64("node"), "n_blocks").cast("int")))
    whole = texts(docs).select(F.col("doc_id").alias("__id"), _text_key().alias("__key"), "text")
    dealt = (members.join(whole, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
             .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "node", "digest", "block", "registers", "text"))
    links = map_slices(dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j"),
                       _links_of_blocks(k, threshold), "u long, v long")
    found = components(links)
    discard(tied_to)

    named = classes.join(found, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # Written, so that the join gets both sides from shuffles and can split a large component.
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    return named.select("digest", "node", "root").join(least, "root")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Linked are rows of which 100 times the common shingles reach ``threshold``
    times all shingles of both.  A null, empty or blank text has no shingles
    and is linked with nothing.  Repeated rows are rows of one component and
    each reported; a component's id is its smallest doc_id, nulls apart (null
    where all are null, and then the row is kept).  Extra columns are ignored;
    an empty table gives no rows; texts are taken whole."""
    rows = materialise(sketch(docs, k), "sketch")
    label = _labelled(docs, rows, k, threshold).select("digest", "component_id")
    out = rows.select("doc_id", "n_shingles", "digest").join(label, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def representatives(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with all their columns: of each component of
    near-duplicates one row stays, the first with the component's id.

    Rows without shingles (null, empty or blank texts) all stay.  Where all ids
    of a component are null, its first row stays.  Other columns keep their
    values whatever they are called."""
    return by_position(docs, lambda d: _representatives(d, k, threshold), "doc_id", "text")


def _representatives(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    numbered = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = materialise(sketch(numbered, k, "__row"), "sketch")
    label = _labelled(numbered, rows, k, threshold)
    named = rows.select("row", "doc_id", "digest").join(label.select("digest", "root", "component_id"), "digest")
    first = (named.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
             .groupBy("root").agg(F.min("row").alias("__kept")).select("__kept"))
    blank = rows.filter("n_shingles = 0").select(F.col("row").alias("__kept"))
    return numbered.join(first.union(blank), F.col("__row") == F.col("__kept"), "left_semi").select(*docs.columns)
