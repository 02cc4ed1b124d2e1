"""Spelling variants: words one code point apart, found by FM-index searches.

Two words one inserted, deleted or replaced code point apart agree in the first
or in the last half of the shorter one.  Words are dealt by both halves to
shards of bounded size; a shard builds a bidirectional FM-index of its words,
delimited, and runs the two searches of the scheme for each: match one half and
its delimiter exactly, from the middle outward, then turn and extend across the
other half to the far delimiter, allowing one error.  A state of the search is
an interval of suffix ranks in the text and the one of equal size in the
reversed text.

Only words that share a half meet.  Where too many do, the rest of them is
halved again, which keeps every near pair by the same argument; a word that
shares its halves with no other is not searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import LOWER, UPPER, materialise, texts

#: Letters of a word; the remainder that loses a code point.
LETTERS = "[a-z\\u00C0-\\u00FF]+"
LOSES = 199

LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Most words that share a half before the rest of them is halved.
GROUP = 2048
#: Code points of a shard's index, about.
SHARD = 250_000
#: Rows between checkpoints of an index's counts.
STEP = 16

PAIRS = "word string, n long, other string, other_n long"


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` (occurrences) of the words of all texts: maximal runs of
    letters, A-Z in lower case; of a run whose crc32 with its document's id is a
    multiple of 199 one code point goes."""
    lower = F.translate("text", UPPER, LOWER)
    runs = texts(docs).select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return (runs.withColumn("h", h).select(F.when(F.col("h") % LOSES == 0, cut).otherwise(F.col("run")).alias("word"))
            .filter(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count))


class Ranks:
    """Burrows-Wheeler transform of a cyclic text, with counts of the symbols
    below each symbol before any row."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        bits, take = max(1, int(symbols - 1).bit_length()), 1
        rank, around = text.astype("i8"), np.arange(n)
        while take * 2 * bits <= 62:  # symbols that fit one number
            rank = rank << (take * bits) | rank[(around + take) % n]
            take *= 2
        while True:
            _, rank = np.unique(rank, return_inverse=True)
            if n == 1 or rank.max() == n - 1 or take >= n:
                break
            rank = rank.astype("i8") * n + rank[(around + take) % n]
            take *= 2
        self.start = np.argsort(rank, kind="stable")
        self.rows = text[self.start - 1]
        self.first = np.searchsorted(text[self.start], np.arange(symbols + 1))
        blocks = n // STEP + 1
        each = np.zeros((blocks + 1, symbols + 1), "i4")
        np.add.at(each, (np.arange(n) // STEP + 1, self.rows.astype("i8") + 1), 1)
        self.counts = each.cumsum(axis=0, dtype="i4").cumsum(axis=1, dtype="i4")
        self.blocks = np.full((blocks, STEP), 255 if text.itemsize == 1 else 65535, text.dtype)
        self.blocks.ravel()[:n] = self.rows

    def below(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows before ``row`` whose symbol is smaller."""
        block, rest = row // STEP, row % STEP
        near = (self.blocks[block] < symbol[:, None]) & (np.arange(STEP) < rest[:, None])
        return self.counts[block, symbol] + near.sum(axis=1)


class BidirectionalIndex:
    """FM-index of distinct words in both directions; ``$`` is symbol 0."""

    def __init__(self, words: list[str]):
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(points, return_inverse=True)
        kind = "u1" if len(self.alphabet) < 254 else "u2"
        self.lengths = np.array([len(w) for w in words])
        ends = np.cumsum(self.lengths)
        text = np.insert((codes + 1).astype(kind), ends - self.lengths, 0)  # $word$word..., around
        self.codes, self.symbols = codes.astype(kind) + np.array(1, kind), len(self.alphabet) + 1
        self.begins = ends - self.lengths
        self.left, self.right = Ranks(text, self.symbols), Ranks(np.ascontiguousarray(text[::-1]), self.symbols)
        delimiters = self.left.start[:self.left.first[1]]  # the suffixes that start with $, in order
        self.word_at = np.searchsorted(self.begins + np.arange(len(words)), delimiters)

    def __len__(self) -> int:
        return len(self.left.rows)

    def extend(self, state: tuple, symbol: np.ndarray, to_left: bool) -> tuple:
        """(interval in the text, in the reversed text, size) after one symbol."""
        lo, other, size = state if to_left else (state[1], state[0], state[2])
        side = self.left if to_left else self.right
        symbol = symbol.astype("i8")
        low, high = side.below(symbol, lo), side.below(symbol, lo + size)
        low_up, high_up = side.below(symbol + 1, lo), side.below(symbol + 1, lo + size)
        new = side.first[symbol] + low_up - low, other + high - low, (high_up - high) - (low_up - low)
        return new if to_left else (new[1], new[0], new[2])

    def next_symbols(self, state: tuple, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) for the symbols that may follow: those in the rows of
        a small interval, all of them for a large one."""
        lo, side = (state[0], self.left) if to_left else (state[1], self.right)
        size = state[2]
        small, large = np.flatnonzero(size <= self.symbols), np.flatnonzero(size > self.symbols)
        which = np.repeat(small, size[small])
        offset = np.arange(len(which)) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
        met = np.unique(which * self.symbols + side.rows[lo[which] + offset])
        return (np.concatenate([met // self.symbols, np.repeat(large, self.symbols)]),
                np.concatenate([met % self.symbols, np.tile(np.arange(self.symbols), len(large))]))

    def near(self, queries: np.ndarray, exact: np.ndarray, from_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) pairs one replaced or inserted code point apart, the
        first (or, else, the last) ``exact`` code points of the query as they are.
        ``queries`` are numbers of words of one length."""
        if not len(queries):
            return queries, queries
        m = int(self.lengths[queries[0]])
        pattern = np.zeros((len(queries), m + 2), self.codes.dtype)
        pattern[:, 1:-1] = self.codes[self.begins[queries][:, None] + np.arange(m)]
        if not from_left:
            pattern = pattern[:, ::-1]  # from here on the exact half comes first, in either direction
        everything = np.full(len(queries), len(self))
        state = (everything * 0, everything * 0, everything)
        for i in range(int(exact.max()), -1, -1):  # from the middle outward, to the delimiter
            on = i <= exact
            moved = self.extend(tuple(x[on] for x in state), pattern[on, i], to_left=from_left)
            for x, y in zip(state, moved):
                x[on] = y
        # Across the other half and its delimiter, with no error yet or one.
        none = (np.arange(len(queries)), *state)
        one = tuple(x[:0] for x in none)
        take = lambda s, at: tuple(x[at] for x in s)
        for i in range(int(exact.min()) + 1, m + 2):
            none = take(none, none[3] > 1)  # an interval of one row is the query itself
            if not len(none[0]) and not len(one[0]):
                break
            ready = np.flatnonzero(exact[none[0]] < i)
            which, symbol = self.next_symbols(take(none, ready)[1:], to_left=not from_left)
            which = ready[which]
            other = (symbol != pattern[none[0][which], i]) & (symbol != 0)
            which, symbol = which[other], symbol[other]
            erred = (none[0][which], *self.extend(take(none, which)[1:], symbol, to_left=not from_left))
            erred = take(erred, erred[3] > 0)
            one = tuple(np.concatenate(x) for x in zip(one, erred))  # inserted: the pattern's symbol is still to come
            one = (one[0], *self.extend(one[1:], pattern[one[0], i], to_left=not from_left))
            one = take(one, one[3] > 0)
            if i <= m:
                one = tuple(np.concatenate(x) for x in zip(one, erred))  # replaced
                exactly = self.extend(take(none, ready)[1:], pattern[none[0][ready], i], to_left=not from_left)
                for x, y in zip(none[1:], exactly):
                    x[ready] = y
        return queries[one[0]], self.word_at[one[1]]


def _shard_pairs(rows: pd.DataFrame) -> Iterator[tuple[str, str]]:
    index = BidirectionalIndex(rows["word"].drop_duplicates().tolist())
    number = {w: i for i, w in enumerate(index.words)}
    asks = rows[rows["asks"]].drop_duplicates(["word", "a", "b"])
    for m, same in asks.groupby(asks["m"]):
        for from_left in (True, False):
            chosen = same[(same["a"] >= same["b"]) == from_left]
            q = np.array([number[w] for w in chosen["word"]], "i8")
            found = index.near(q, chosen["a" if from_left else "b"].to_numpy(), from_left)
            yield from zip(*found)


def _searched(rows: pd.DataFrame) -> pd.DataFrame:
    words = rows[["word", "n"]].drop_duplicates()
    text, n = words["word"].to_numpy(), words["n"].to_numpy()
    pairs = set(_shard_pairs(rows))
    u = np.array([p for p, _ in pairs], "i8")
    v = np.array([q for _, q in pairs], "i8")
    both = np.concatenate([u, v]), np.concatenate([v, u])
    return pd.DataFrame({"word": text[both[0]], "n": n[both[0]], "other": text[both[1]], "other_n": n[both[1]]})


def _key() -> Column:
    piece = lambda c, n: F.substring("word", c, F.col(n))
    return F.xxhash64("m", "a", "b", piece(F.lit(1), "a"), piece(F.length("word") - F.col("b") + 1, "b"))


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``other`` and ``other_n`` of every pair of words (distinct,
    none empty) one code point apart, both ways round."""
    half = F.floor(F.col("m") / 2).cast("int")
    halves = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), half.alias("b")))
    # A pair is looked for among those of the length of its shorter word, which asks.
    level = (words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"))
             .filter("m > 0").withColumn("asks", F.length("word") == F.col("m"))
             .withColumn("cut", F.explode(halves)).select("word", "n", "m", "asks", "cut.*").withColumn("key", _key()))
    dealt = None
    while True:
        level = materialise(level, "spelling-halves")
        sizes = level.groupBy("key").agg(F.count("*").alias("size"), F.max("asks").alias("asked")).filter("size > 1 AND asked").drop("asked")
        level = level.join(sizes, "key")
        rest = F.col("m") - F.col("a") - F.col("b")
        full = (F.col("size") > GROUP) & (rest > 1)
        fitting = level.filter(~full).drop("size")
        dealt = fitting if dealt is None else dealt.union(fitting)
        level = level.filter(full)
        if level.isEmpty():
            break
        more = F.floor(rest / 2).cast("int")
        halves = F.array(F.struct((F.col("a") + more).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + more).alias("b")))
        level = level.withColumn("cut", F.explode(halves)).select("word", "n", "m", "asks", "cut.*").withColumn("key", _key())
    dealt = materialise(dealt, "spelling-groups")
    shards = int((dealt.agg(F.sum(F.length("word") + 1)).first()[0] or 0) // SHARD) + 1
    # A shard is little to read and much to search: its number of partitions is given, not left to sizes.
    found = (dealt.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).repartition(shards, "shard").groupBy("shard")
             .applyInPandas(_searched, PAIRS))
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of every word with a form, by doubling: a form has
    ``FACTOR`` times the occurrences, so chains are short and end."""
    state = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = materialise(state.join(up, "root", "left"), "spelling-roots")
        if joined.filter("next IS NOT NULL").isEmpty():
            return state
        state = joined.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word of
    at least ``least_length`` code points and ``least_count`` occurrences.

    A word's form is the most frequent word near it (ties: the first in code
    point order) if that has ``factor`` times its occurrences; its root is where
    forms lead.  A null or empty text has no words; a null id counts as no
    digits; repeated rows count each; extra columns are ignored; an empty table
    gives no rows."""
    words = materialise(vocabulary(docs, least_length, least_count), "spelling-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = F.col("best.n") * -1 >= F.col("n") * factor
    rows = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-forms")
    return (rows.join(_roots(rows.filter("form IS NOT NULL")), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
