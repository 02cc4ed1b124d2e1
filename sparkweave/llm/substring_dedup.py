"""Passages that repeat: difference-cover anchors, extended to whole windows.

A window is ``window`` consecutive words.  With a difference cover D modulo a
period v, two equal windows at any two places i and j have an offset d below v
with both i + d and j + d in D modulo v; so both hold, there, the same anchor of
``window - v + 1`` words.  Anchors are hashed at cover positions alone.  Those
that occur twice are extended: every window around them is hashed whole (96
bits), and windows that occur twice are removed.

Texts are numbered and written once, in buckets of the number, so that both
joins that bring places back to texts leave the texts where they are.  What a
task meets twice is known to repeat: one of it goes on under its hash and the
others under numbers of their own, so that a passage of a third of all texts
sends a few rows a task into its group.  Groups are streamed, never collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import SLICE_ROWS, map_slices, materialise, texts
from sparkweave.session import fresh_path

WINDOW = 35
#: Perfect difference covers: every difference modulo the period, once.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Places a task looks at together for what it meets twice.
TOGETHER = 1 << 20
KEYED, PLACES = "k0 long, row long, tail long", "row long, pos int"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """Largest period up to three fifths of a window, and its cover."""
    period = max(p for p in COVERS if p == 1 or p <= 3 * window // 5)
    return period, COVERS[period]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Hashed:
    """Two independent 64-bit hashes of the words of several texts, end to end,
    and of any of their windows."""

    def __init__(self, documents: list[list[bytes]]):
        self.sizes = np.array([len(d) for d in documents], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        digest = xxhash.xxh3_128_digest
        raw = np.frombuffer(b"".join([digest(w) for d in documents for w in d]), "<u8").reshape(-1, 2)
        power = np.ones(len(raw) + 1, "u8")
        np.cumprod(np.full(len(raw), _BASE), out=power[1:])
        self.back = np.ones(len(raw) + 1, "u8")
        np.cumprod(np.full(len(raw), _INVERSE), out=self.back[1:])
        self.sums = np.zeros((2, len(raw) + 1), "u8")
        np.cumsum(raw.T * power[:-1], axis=1, out=self.sums[:, 1:])

    def windows(self, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """Hash of the ``length`` words from each place on."""
        s = self.sums[which]
        return mixed((s[at + length] - s[at]) * self.back[at]).view("i8")

    def positions(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and position of every word."""
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        return text, np.arange(len(text)) - self.starts[text]


def _known(key: np.ndarray, more: np.ndarray, row: np.ndarray, pos: np.ndarray) -> dict:
    """Places of a task under ``k0`` and a ``tail``: 32 more bits of the key, whether
    the place is known to repeat, and its position.  Of places with a key that
    occurs twice the first stays under it and the others, which need not meet
    anything any more, get small numbers as keys, which spread them and take
    little room; all of them are known."""
    order = np.lexsort((more, key))
    key, more, row, pos = key[order], more[order], row[order], pos[order]
    same = (key[1:] == key[:-1]) & (more[1:] == more[:-1])
    later, repeated = np.append(False, same), np.append(same, False)
    repeated |= later
    key[later], more[later] = -1 - np.arange(later.sum()), 0
    return {"k0": key, "row": row, "tail": (more.astype("i8") << 32) | (repeated.astype("i8") << 31) | pos}


def _emitted(found: Iterator[tuple[np.ndarray, ...]]) -> Iterator[dict]:
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= TOGETHER:
            yield _known(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield _known(*(np.concatenate(x) for x in zip(*held)))


def _anchors(window: int) -> Callable:
    period, cover = cover_for(window)
    length, covered = window - period + 1, np.isin(np.arange(period), cover)

    def run(batches):
        def found():
            for b in batches:
                hashed = Hashed([x.encode().split() for x in b["text"].to_pylist()])
                text, pos = hashed.positions()
                # Only texts of a whole window have one; their anchors end within them.
                at = np.flatnonzero(covered[pos % period] & (pos + length <= hashed.sizes[text]) & (hashed.sizes[text] >= window))
                row = b["row"].to_numpy()
                yield hashed.windows(at, length), np.zeros(len(at), "i4"), row[text[at]], pos[at]

        yield from _emitted(found())

    return run


def _windows(window: int) -> Callable:
    reach = cover_for(window)[0]

    def run(batches):
        def found():
            for b in batches:
                hashed = Hashed([x.encode().split() for x in b["text"].to_pylist()])
                text, pos = hashed.positions()
                # Windows that hold a repeated anchor start up to a period before it.
                anchors, of = b["places"].flatten().to_numpy(), np.repeat(np.arange(b.num_rows), b["places"].value_lengths().to_numpy())
                change = np.zeros(len(text) + 1, "i4")
                np.add.at(change, hashed.starts[of] + np.maximum(anchors - reach + 1, 0), 1)
                np.add.at(change, hashed.starts[of] + anchors + 1, -1)
                at = np.flatnonzero((np.cumsum(change)[:-1] > 0) & (pos + window <= hashed.sizes[text]))
                row = b["row"].to_numpy()
                yield hashed.windows(at, window, 0), hashed.windows(at, window, 1).astype("i4"), row[text[at]], pos[at]

        yield from _emitted(found())

    return run


def _repeated(tables: Iterator) -> Iterator[dict]:
    """Places whose key (sorted input) occurs twice or is known to."""
    held: list[np.ndarray] | None = None
    for t in tables:
        rows = [t[c].to_numpy() for c in ("k0", "tail", "row")]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
        starts = _starts(*rows[:2])
        held = [x[starts[-1]:] for x in rows]  # the last group may go on
        yield _of_groups([x[:starts[-1]] for x in rows], starts[:-1])
    if held is not None:
        yield _of_groups(held, np.zeros(1, "i8"))


def _starts(key: np.ndarray, tail: np.ndarray) -> np.ndarray:
    more = tail >> 32
    return np.append(0, np.flatnonzero((key[1:] != key[:-1]) | (more[1:] != more[:-1])) + 1)


def _of_groups(rows: list[np.ndarray], starts: np.ndarray) -> dict:
    _, tail, row = rows
    if not len(starts):
        return {"row": row, "pos": tail.astype("i4")}
    sizes = np.diff(np.append(starts, len(row)))
    known = np.logical_or.reduceat((tail >> 31 & 1).astype(bool), starts)
    repeats = np.repeat((sizes > 1) | known, sizes)
    return {"row": row[repeats], "pos": (tail[repeats] & 0x7FFFFFFF).astype("i4")}


def _places(found: DataFrame) -> DataFrame:
    """By text, the places whose key occurs twice."""
    together = found.repartition("k0").sortWithinPartitions("k0", "tail")
    dup = map_slices(together, _repeated, PLACES, rows=SLICE_ROWS * 64)
    return dup.groupBy("row").agg(F.collect_list("pos").alias("places"))


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written in buckets of ``key``: joins on it don't move its rows."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"sparkweave_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.option("path", fresh_path(spark, "bucketed")).option("compression", "zstd")
     .bucketBy(buckets, key).saveAsTable(name))
    written = spark.table(name)
    written.schema  # resolved; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return written


def remove_repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text`` (kept words, one space between), ``n_words`` and
    ``n_removed`` of every row.

    Words ``[^\\x20\\x09-\\x0D]+`` stay as they are.  A word goes if a window of
    words that holds it occurs at any other place, in its own text or another;
    windows are those of the input.  A null or empty text has no words, a text
    shorter than a window keeps all; repeated rows and null ids are texts of
    their own; extra columns are ignored; an empty table gives no rows."""
    rows = _bucketed(texts(docs).withColumn("row", F.monotonically_increasing_id()), "row")
    anchors = map_slices(rows.select("row", "text"), _anchors(window), KEYED)
    places = materialise(_places(anchors), "anchors")
    extended = map_slices(rows.select("row", "text").join(places.hint("shuffle_hash"), "row"), _windows(window), KEYED)
    starts = materialise(_places(extended), "windows")

    def kept(batches):
        for b in batches:
            out = {k: [] for k in ("doc_id", "text", "n_words", "n_removed")}
            for doc, text, at in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["places"]):
                words = text.encode().split()
                n = len(words)
                if at.is_valid:
                    change = np.zeros(n + 1, "i4")
                    where = at.values.to_numpy()
                    np.add.at(change, where, 1)
                    np.add.at(change, where + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                for k, v in zip(out, (doc, b" ".join(words).decode(), n, n - len(words))):
                    out[k].append(v)
            yield out

    joined = rows.select("row", "doc_id", "text").join(starts.hint("shuffle_hash"), "row", "left")
    return map_slices(joined.select("doc_id", "text", "places"), kept, "doc_id long, text string, n_words long, n_removed long")


def removal_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What ``remove_repeated`` does, with the kept text as its sha256."""
    return remove_repeated(docs, window).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
