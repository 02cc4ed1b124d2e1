"""Hierarchical Pitman-Yor language model and per-document scores.

Words are drawn from restaurants, one for each word that was seen before
another.  The restaurant of a word has as its parent that of the word's kind
(``KINDS``); those share two parents (after a word, and after a mark or at the
beginning), which share the root over words.  A word never seen as a context
goes to its kind.  The root's base is diffuse: it serves each distinct word at
one table, and what is left for new tables is the probability of a word never
seen, which all such words share as one class, as they do in the base score.

Seating is sampled by blocked Gibbs sweeps.  All customers of a word in a
restaurant are seated anew by the Chinese-restaurant rule, one after another
(beyond 20, a twentieth of those seated at a time), and the proposal is
accepted by the ratio of its normalisers.  A sweep first seats the (context,
word) pairs, given the tables of their context and the chance of the word in
its parent, and then the levels above, whose customers are the tables below;
given the totals of their restaurants, words are independent there.  A pair
that occurs once has one table, so only the others are seated.  Seeds come from
the pair or word and the sweep, so a lost task seats the same way again.

Tables of pairs and contexts and chances of words in the kinds are averaged
over the sweeps after the first ones; a prediction puts these averages
together, and its probabilities sum to 1.

Counts are whole-corpus aggregates, combined in the tasks.  In a sweep the most
frequent contexts and words (at most ``HEAVY`` each, 16 MB) are broadcast; pairs
of others are joined, and only contexts and words with a pair that occurs twice
are written anew.  Pairs travel packed (``packed``): those of many texts, which
share words and contexts, as one value for each task they are dealt to.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain, count

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import SLICE_BYTES, arrow_schema, discard, map_slices, materialise, texts, word_hash, words
from sparkweave.llm.packed import grouped, indexed, pack, steps, summed, unpack

KINDS = 8  # start; after a sentence mark; another mark; a digit; a word of up to 2, 4, 7, more bytes
PARENT = np.array([0, 0, 0, 0, 1, 1, 1, 1])  # of each kind's restaurant
SWEEPS, BURN_IN = 4, 1
STRENGTH = 1.0
HEAVY = 131_072
END = b""  # what closes a text
#: Characters a task gathers before it emits their counts.
GATHERED = 16_000_000
#: Words a task seats at a time.
WORDS = 200_000

_C = [f"c{k}" for k in range(KINDS)]


def _kind() -> Column:
    """Of a row's context."""
    return F.col("u").bitwiseAND(F.lit(7))


def _kind_of_last() -> np.ndarray:
    kinds = np.full(256, 2, "i8")
    kinds[list(b".!?")] = 1
    kinds[list(range(48, 58))] = 3
    kinds[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 4
    return kinds


_LAST = _kind_of_last()


def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, context kind) of every token of a text, its end included."""
    ws = words(text)
    n = len(ws)
    h = np.fromiter(map(word_hash, chain(ws, (END,))), "u8", n + 1).view("i8")
    kinds = np.zeros(n + 1, "i8")
    if n:
        last = _LAST[np.frombuffer(b"".join([w[-1:] for w in ws]), "u1")]
        size = np.searchsorted([2, 4, 7], np.fromiter(map(len, ws), "i8", n))  # 0..3
        kinds[1:] = np.where(last == 4, 4 + size, last)
    return h, kinds


def cut(texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many texts: (tokens of each; for each token, the number of its word and
    of its context; hashes of the words; keys of the contexts).  A word and the
    context it is have the same number, the last context is the beginning."""
    ws = [words(x) for x in texts_]
    for x in ws:
        x.append(END)
    sizes = np.fromiter(map(len, ws), "i8", len(ws))
    n, seen = int(sizes.sum()), {}
    at = np.fromiter(map(seen.setdefault, chain.from_iterable(ws), count()), "i8", n)  # where a word is first
    number = np.empty(n, "i8")
    number[np.fromiter(seen.values(), "i8", len(seen))] = np.arange(len(seen))
    word = number[at]
    h = np.fromiter(map(word_hash, seen), "u8", len(seen)).view("i8")
    last = _LAST[np.frombuffer(b"".join([w[-1:] or b" " for w in seen]), "u1")]
    kinds = np.where(last == 4, 4 + np.searchsorted([2, 4, 7], np.fromiter(map(len, seen), "i8", len(seen))), last)
    context = np.empty(n, "i8")
    context[1:] = word[:-1]
    context[np.cumsum(sizes) - sizes] = len(h)
    return sizes, word, context, h, np.append(h & ~7 | kinds, 0)


def contexts(h: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Key of each token's context: 61 bits of the word before, then its kind."""
    u = np.zeros_like(h)
    u[1:] = h[:-1] & ~7
    return u | kinds


def mixed(u: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit hash of a (context, word) pair."""
    x = u.view("u8") * np.uint64(0x9E3779B97F4A7C15) ^ h.view("u8")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view("i8")


def _often(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of words that would make one of ``n`` tasks uneven; judged by the
    first texts of each partition, as this only says where words are counted."""

    def first(batches):
        seen, size = Counter(), 0
        for b in batches:
            for x in b["text"].to_pylist():
                seen.update(words(x))
                size += len(x)
                if size > 200_000:
                    break
            if size > 200_000:
                break
        total = seen.total()
        some = [w for w, c in seen.items() if c * 8 * n >= total]
        yield {"h": np.fromiter(map(word_hash, some), "u8", len(some)).view("i8")}

    some = map_slices(texts(docs).select("text"), first, "h long", cut=(64, SLICE_BYTES)).distinct().collect()
    return np.unique([*[r.h for r in some], int(np.array([word_hash(END)], "u8").view("i8")[0])])


def pair_counts(docs: DataFrame) -> DataFrame:
    """Occurrences ``c`` of each word ``h`` (64-bit hash) after each context
    ``u``, in all texts.  Two words of a vocabulary of 10 million share a hash
    with a probability of about 3e-6, two contexts with 2e-5."""

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = _often(docs, n)

    def emit(held: list[str]) -> dict:
        _, word, context, h, u = cut(held)
        by = np.argsort(h)
        rank = np.empty(len(h), "i8")
        rank[by] = np.arange(len(h))
        h, key = h[by], np.sort(rank[word] * len(u) + context)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        c, word = np.diff(first, append=len(key)), key[first] // len(u)
        context = key[first] - word * len(u)
        at, spread = _dealt(h, n)[word], np.flatnonzero(_found(often, h)[1][word])
        at[spread] = (mixed(u[context[spread]], h[word[spread]]).view("u8") % np.uint64(n)).astype("i8")
        order = _order(at, n)
        at, word, context, c = at[order], word[order], context[order], c[order]
        rows = []
        for k, x in grouped(at, n):
            us, place = indexed(u[context[x]])
            rows.append((k, _COUNTS, 0, pack(steps(us), place, steps(h[word[x]]), c[x] - 1)))
        return _moved(rows)

    def counted(batches):
        held, size = [], 0
        for b in batches:
            for x in b["text"].to_pylist():
                if held and (size + len(x) > GATHERED or len(held) == SLAB_TEXTS):
                    yield emit(held)
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield emit(held)

    def added(batches):
        parts = [(summed(us)[place], summed(h), c + 1) for us, place, h, c in (unpack(x) for _, x in _received(batches)[_COUNTS])]
        if parts:
            u, h, c = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((u, h))
            u, h, c = u[order], h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (h[1:] != h[:-1])]))
            u, h, c = u[first], h[first], np.add.reduceat(c, first)
            for x in range(0, len(u), WORDS):
                yield {k: v[x:x + WORDS] for k, v in (("u", u), ("h", h), ("c", c))}

    moved = map_slices(texts(docs).select("text"), counted, _MOVED)
    return map_slices(moved.repartitionById(n, "at"), added, "u long, h long, c long")


def _by_word(pairs: DataFrame, customers: Column, *more: Column) -> DataFrame:
    """Sums of ``customers`` of each word after each kind."""
    return pairs.groupBy("h").agg(*more, *[F.sum(F.when(_kind() == k, customers).otherwise(0)).alias(c) for k, c in enumerate(_C)])


def word_counts(docs: DataFrame) -> DataFrame:
    """``h`` and its occurrences after each kind, in all texts."""
    return _by_word(pair_counts(docs), F.col("c"))


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each hash and seed."""
    x = h.view("u8") + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 1e-17


def _few(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial number, by inversion for means below 10, else by its normal
    approximation."""
    z = np.sqrt(2) * _erfinv(2 * u - 1)
    out = np.clip(np.rint(n * p + z * np.sqrt(n * p * (1 - p))), 0, n)
    left = np.flatnonzero(n * p < 10)
    m, odds = n[left], p[left] / (1 - p[left])
    chance = (1 - p[left]) ** m
    below, k = chance.copy(), 0
    out[left] = 0
    while (more := (u[left] > below) & (k < m)).any():
        left, m, odds, chance, below = (x[more] for x in (left, m, odds, chance, below))
        k += 1
        chance = chance * odds * (m - k + 1) / k
        below = below + chance
        out[left] = k
    return out.astype("i8")


def _erfinv(x: np.ndarray) -> np.ndarray:
    a = np.log1p(-np.clip(x, -1 + 1e-12, 1 - 1e-12) ** 2)
    b = 2 / (np.pi * 0.147) + a / 2
    return np.sign(x) * np.sqrt(np.sqrt(b * b - a / 0.147) - b)


def seat(c: np.ndarray, new: np.ndarray, d: float | np.ndarray, h: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(tables, log of the product of normalisers) of ``c`` customers of a word
    seated one after another; ``new`` is the weight of a new table."""
    t, logs = (c > 0).astype("i8"), np.zeros(len(c))
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(-c[many], kind="stable")]  # those still to be seated are the first ones
    c_, new, h, d = c[many], new[many], h[many], np.broadcast_to(d, len(c))[many]
    t_, logs_, sizes = np.ones(len(many), "i8"), np.zeros(len(many)), -c_
    n, seated, step = len(many), 1, 0
    while n:
        size = max(1, seated // 20)
        u, total = _uniform(h[:n], seed * 1009 + step), seated - d[:n] * t_[:n] + new[:n]
        if size == 1:
            logs_[:n] += np.log(total)
            t_[:n] += u * total < new[:n]
        else:
            group = np.minimum(size, c_[:n] - seated)
            logs_[:n] += group * np.log(total)
            t_[:n] += _few(group, new[:n] / total, u)
        seated, step = seated + size, step + 1
        n = int(np.searchsorted(sizes, -seated))
    t[many], logs[many] = t_, logs_
    return t, logs


class Chain:
    """States of the sampler for a batch of words, replayed from the totals that
    the sweeps before it left."""

    def __init__(self, h: np.ndarray, c: np.ndarray, discounts: dict):
        self.h, self.c, self.d = h, c, discounts
        self.t = np.minimum(c, 1)
        self.t2 = np.stack([np.minimum(x, 1) for x in self._parents(self.t)], axis=1)
        self.state: dict = {}

    def _parents(self, t: np.ndarray) -> list[np.ndarray]:
        return [t[:, PARENT == g].sum(axis=1) for g in (0, 1)]

    def totals(self) -> dict[str, np.ndarray]:
        c2 = np.stack(self._parents(self.t), axis=1)
        return {"c1": self.c.sum(axis=0), "t": self.t.sum(axis=0), "c2": c2.sum(axis=0),
                "m1": (c2 == 1).sum(axis=0), "m2": (c2 == 2).sum(axis=0), "t2": self.t2.sum(axis=0), "c3": np.array([self.t2.sum()]),
                "n1": np.array([(self.t2.sum(axis=1) == 1).sum()]), "n2": np.array([(self.t2.sum(axis=1) == 2).sum()])}

    def predict(self, totals: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each word in the root, the parents and the kinds."""
        d, s = self.d, STRENGTH
        root = (self.t2.sum(axis=1) - d["root"]) / (s + totals["c3"][0])
        c2 = np.stack(self._parents(self.t), axis=1)
        middle = (c2 - d["parent"] * self.t2 + (s + d["parent"] * totals["t2"]) * root[:, None]) / (s + totals["c2"])
        leaf = (self.c - d["leaf"] * self.t + (s + d["leaf"] * totals["t"]) * middle[:, PARENT]) / (s + totals["c1"])
        return root, middle, leaf

    def sweep(self, number: int, totals: dict, customers: np.ndarray) -> None:
        """Seats ``customers`` anew, given the totals of the sweep before."""
        root, middle, _ = self.predict(totals)
        self.c, self.t = customers, np.minimum(self.t, customers)
        d, s = self.d, STRENGTH
        for k in range(KINDS):
            new = (s + d["leaf"][k] * totals["t"][k]) * np.maximum(middle[:, PARENT[k]], 1e-300)
            self.t[:, k] = self._move(("leaf", k), self.c[:, k], self.t[:, k], new, d["leaf"][k], number * 31 + k)
        for g, c2 in enumerate(self._parents(self.t)):
            new = (s + d["parent"][g] * totals["t2"][g]) * np.maximum(root, 1e-300)
            self.t2[:, g] = self._move(("parent", g), c2, np.minimum(self.t2[:, g], c2), new, d["parent"][g], number * 31 + 20 + g)

    def _move(self, which, c, old, new, d, seed) -> np.ndarray:
        """Accepts a fresh seating by the ratio of normalisers; what it is
        compared with is the last accepted one of the same customers."""
        t, logs = seat(c, new, d, self.h, seed)
        before = self.state.get(which)
        take = np.ones(len(c), bool)
        if before is not None:
            take = (before[1] != c) | (np.log(_uniform(self.h, seed * 7 + 3)) < logs - before[0])
        self.state[which] = (np.where(take, logs, before[0] if before is not None else 0), c.copy())
        return np.where(take, t, old)


class Model:
    """What the driver keeps: totals of the sweeps, and averaged chances of a
    word never seen."""

    def __init__(self, n_tokens: int, n_words: int, discounts: dict, totals: list[dict]):
        self.n_tokens, self.n_words, self.discounts, self.totals = n_tokens, n_words, discounts, totals

    def replayed(self, h: np.ndarray, history: list[np.ndarray]) -> Chain:
        """The chain of words after the sweeps whose customers ``history`` has."""
        chain_ = Chain(h, history[0], self.discounts)
        for i, customers in enumerate(history[1:]):
            chain_.sweep(i, self.totals[i], customers)
        return chain_

    def probabilities(self, h: np.ndarray, c: np.ndarray | list[np.ndarray]) -> np.ndarray:
        """Averaged predictive probability of each word in each kind; ``c``: its
        customers there, in each sweep if they change."""
        history = c if isinstance(c, list) else [c] * len(self.totals)
        lone = sum(x.sum(axis=1) for x in history) == len(history)  # one customer, always: one table, whatever the word
        out = np.empty(history[0].shape)
        out[~lone] = self._averaged(h[~lone], [x[~lone] for x in history])
        out[lone] = self._averaged(np.arange(KINDS), [np.eye(KINDS, dtype="i8")] * len(history))[history[0][lone].argmax(axis=1)]
        return out

    def _averaged(self, h: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
        chain_, out = Chain(h, history[0], self.discounts), np.zeros(history[0].shape)
        for i, totals in enumerate(self.totals[1:]):
            chain_.sweep(i, self.totals[i], history[i + 1])
            if i >= BURN_IN:
                out += chain_.predict(totals)[2]
        return out / (len(self.totals) - 1 - BURN_IN)

    def unseen(self) -> np.ndarray:
        """Averaged probability, in each kind, of all words never seen."""
        out, d, s = np.zeros(KINDS), self.discounts, STRENGTH
        for totals in self.totals[1 + BURN_IN:]:
            root = (s + d["root"] * self.n_words) / (s + totals["c3"][0])
            middle = (s + d["parent"] * totals["t2"]) / (s + totals["c2"]) * root
            out += (s + d["leaf"] * totals["t"]) / (s + totals["c1"]) * middle[PARENT]
        return out / (len(self.totals) - 1 - BURN_IN)

    def base(self, c: np.ndarray) -> np.ndarray:
        """log10 of the additively smoothed unigram probability."""
        return np.log10((c + 0.5) / (self.n_tokens + 0.5 * (self.n_words + 1)))


def _discount(n1, n2) -> np.ndarray:
    """Discount by counts of words seen once and twice."""
    n1, n2 = np.asarray(n1, float), np.asarray(n2, float)
    return np.clip((n1 + 0.5) / (n1 + 2 * n2 + 1), 0.1, 0.9)


def _history(b, sweeps: int) -> list[np.ndarray]:
    """Customers of words in the first seating and in each of the sweeps."""
    named = lambda i: [f"{c}_{i}" if i and f"{c}_{i}" in b.schema.names else c for c in _C]
    return [np.stack([b[c].to_numpy() for c in named(i)], axis=1) for i in range(sweeps + 1)]


_TOTALS = [("c1", KINDS), ("t", KINDS), ("c2", 2), ("m1", 2), ("m2", 2), ("t2", 2), ("c3", 1), ("n1", 1), ("n2", 1)]


def _total(words: DataFrame, model: Model, sweeps: int) -> dict[str, np.ndarray]:
    """Totals of the kinds and above after so many sweeps."""
    flat = [f"{k}_{i}" for k, n in _TOTALS for i in range(n)]

    def run(batches):
        for b in batches:
            t = model.replayed(b["h"].to_numpy(), _history(b, sweeps)).totals()
            yield {f"{k}_{i}": [int(t[k][i])] for k, n in _TOTALS for i in range(n)}

    r = map_slices(words, run, ", ".join(f"{c} long" for c in flat), WORDS).agg(*[F.sum(c).alias(c) for c in flat]).first()
    return {k: np.array([r[f"{k}_{i}"] or 0 for i in range(n)], float) for k, n in _TOTALS}


def _begun(words: DataFrame, n: Column) -> Model:
    """Model after the first seating of a (written) table of words, of which
    ``n`` are the occurrences."""
    one, two = ([F.count(F.when(F.col(c) == m, 1)).alias(f"{c}_{m}") for c in _C] for m in (1, 2))
    r = words.agg(F.count("*").alias("n_words"), F.sum(n).alias("n"), *one, *two).first()
    leaf = _discount([r[f"{c}_1"] for c in _C], [r[f"{c}_2"] for c in _C])
    model = Model(r.n or 0, r.n_words, {"leaf": leaf}, [])
    t = _total(words, model, 0)  # the first seating, which gives the discounts of the upper levels
    model.discounts["parent"] = _discount(t["m1"], t["m2"])
    model.discounts["root"] = float(_discount(t["n1"], t["n2"])[0])
    model.totals.append(t)
    return model


def fit(counts: DataFrame) -> Model:
    """Model of the kinds and above, of a (written) table of word counts."""
    model = _begun(counts, sum(F.col(c) for c in _C))
    for sweep in range(1, SWEEPS + 1):
        model.totals.append(_total(counts, model, sweep))
    return model


def fit_pairs(pairs: DataFrame) -> tuple[Model, np.ndarray, DataFrame, DataFrame, DataFrame]:
    """(model of the kinds and above, discounts of the contexts by kind,
    contexts, words, pairs) of a (written) table of pair counts.  Contexts have
    ``u``, customers ``n`` and ``tables``; words have ``h``, occurrences ``n``
    and their customers in each sweep; pairs have ``u``, ``h`` and ``left``
    (customers less the discounts of their tables)."""
    seen = {r.k: r for r in pairs.groupBy(_kind().alias("k")).agg(*[F.count(F.when(F.col("c") == m, 1)).alias(f"n{m}") for m in (1, 2)]).collect()}
    d = np.array([float(_discount(seen[k].n1, seen[k].n2)) if k in seen else 0.75 for k in range(KINDS)])
    again = F.count_if(F.col("c") > 1).alias("again")
    places = materialise(pairs.groupBy("u").agg(F.sum("c").alias("n"), F.count("*").alias("types"), again), "contexts")
    words = materialise(_by_word(pairs, F.lit(1), F.sum("c").alias("n"), again), "words")
    model = _begun(words, F.col("n"))
    # Contexts and words whose pairs all occur once never get further tables: they stay as they are written, and
    # words of one pair are counted once.
    settled, lone = words.filter("again = 0"), sum(F.col(c) for c in _C) == 1
    several, fixed = settled.filter(~lone), _total(settled.filter(lone), model, 0)
    here = places.filter("again > 0").select("u", "n", "types", F.col("types").alias("tables"), F.lit(0).cast("long").alias("sum"))
    live = words.filter("again > 0")
    often, heavy = _frequent(here), _frequent(live)
    keys = _sent(pairs, [here.filter(often).select("u"), live.filter(heavy).select("h")])

    def sided(batches):
        for b in batches:
            u, h = b["u"].to_numpy(), b["h"].to_numpy()
            (us,), (hs,) = keys.value
            yield {"u": u, "h": h, "c": b["c"], "near": _found(us, u)[1] & _found(hs, h)[1], "t": np.ones(len(u), "i8"),
                   "logs": np.zeros(len(u)), "sum": np.zeros(len(u), "i8")}

    state = materialise(map_slices(pairs.filter("c > 1"), sided, _STATE, WORDS), "pairs-0")
    keys.destroy()
    before = (state,)
    for sweep in range(1, SWEEPS + 1):

        def chances(batches, done=sweep - 1, model=model):
            for b in batches:
                h = b["h"].to_numpy()
                chance = model.replayed(h, _history(b, done)).predict(model.totals[done])[2]
                yield {"h": h} | {f"p{k}": chance[:, k] for k in range(KINDS)}

        chance = lambda some: map_slices(some, chances, "h long, " + ", ".join(f"p{k} double" for k in range(KINDS)), WORDS)
        shared = _sent(pairs, [here.filter(often).select("u", "tables"), chance(live.filter(heavy))])

        def seated(batches, sweep=sweep, shared=shared):
            (us, ns), (hs, *ps) = shared.value
            ps = np.stack(ps, axis=1)
            for b in batches:
                u, h, c, old, p, n = (b[x].to_numpy() for x in ("u", "h", "c", "t", "p", "tables"))
                at_u, has_u = _found(us, u)
                at_h, has_h = _found(hs, h)
                n, p = n.copy(), p.copy()  # of those that were joined, else not a number
                n[has_u], p[has_h] = ns[at_u[has_u]], ps[at_h[has_h], u[has_h] & 7]
                discount, key = d[u & 7], mixed(u, h)
                t, logs = seat(c, (STRENGTH + discount * n) * np.maximum(p, 1e-300), discount, key, sweep * 31 + 25)
                if sweep > 1:
                    before = b["logs"].to_numpy()
                    take = np.log(_uniform(key, (sweep * 31 + 25) * 7 + 3)) < logs - before
                    t, logs = np.where(take, t, old), np.where(take, logs, before)
                yield {"u": u, "h": h, "c": c, "near": b["near"], "t": t, "logs": logs, "sum": b["sum"].to_numpy() + (t if sweep > BURN_IN else 0)}

        # Pairs of a frequent context and word find both in the task; only the others are joined.
        unknown, own = F.lit(float("nan")), [f.name for f in arrow_schema(_STATE)]
        near = state.filter("near").select(*own, unknown.alias("tables"), unknown.alias("p"))
        far = (state.filter("not near").join(here.filter(~often).select("u", F.col("tables").cast("double")), "u", "left")
               .join(chance(live.filter(~heavy)), "h", "left")
               .select(*own, F.coalesce("tables", unknown).alias("tables"),
                       F.coalesce(F.element_at(F.array(*[f"p{k}" for k in range(KINDS)]), (_kind() + 1).cast("int")), unknown).alias("p")))
        state = materialise(map_slices(near.union(far), seated, _STATE, WORDS), f"pairs-{sweep}")
        shared.destroy()
        further = state.filter("t > 1").withColumn("more", F.col("t") - 1)
        here = here.drop("tables").join(further.groupBy("u").agg(F.sum("more").alias("more")), "u", "left").withColumn(
            "tables", F.col("types") + F.coalesce("more", F.lit(0)))
        here = materialise(here.select("u", "n", "types", "tables", (F.col("sum") + (F.col("tables") if sweep > BURN_IN else 0)).alias("sum")), f"contexts-{sweep}")
        added = _by_word(further, F.col("more")).select("h", *[F.col(c).alias(f"more_{c}") for c in _C])
        live = materialise(live.join(added, "h", "left").select(
            *live.columns, *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(f"{c}_{sweep}") for c in _C]), f"words-{sweep}")
        totals = [fixed, _total(live, model, sweep), _total(several, model, sweep)]
        model.totals.append({k: sum(t[k] for t in totals) for k, _ in _TOTALS})
        discard(*before)  # a sweep's tables go when the next one's are there
        before = (state, here, live)
    discount = F.element_at(F.array(*[F.lit(float(x)) for x in d]), (_kind() + 1).cast("int"))
    kept = SWEEPS - BURN_IN
    left = (pairs.filter("c = 1").select("u", "h", (1 - discount).alias("left"))
            .union(state.select("u", "h", (F.col("c") - discount * F.col("sum") / kept).alias("left"))))
    contexts_ = here.select("u", "n", (F.col("sum") / kept).alias("tables")).union(
        places.filter("again = 0").select("u", "n", F.col("types").cast("double")))
    all_words = live.union(settled.select(*words.columns, *[F.col(c) for _ in range(SWEEPS) for c in _C]))
    all_words.made_of = (words, live)
    return model, d, contexts_, all_words, left


#: Of a pair that occurs more than once; ``near``: both its context and its word are frequent.
_STATE = "u long, h long, c long, near boolean, t long, logs double, sum long"


def _sent(df: DataFrame, tables: list[DataFrame]):
    """Broadcast of the columns of (bounded) tables, each in the order of its first."""
    columns = [[c.to_numpy() for c in t.toArrow().columns] for t in tables]
    return df.sparkSession.sparkContext.broadcast([[c[np.argsort(first)] for c in (first, *rest)] for first, *rest in columns])


def _frequent(table: DataFrame) -> Column:
    """Whether a row is one of the at most ``HEAVY`` of the largest ``n``."""
    step, room, least = F.floor(F.log2("n") * 4), HEAVY, None
    for r in table.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    return step >= least if least is not None else F.lit(False)


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the sorted ``known``, whether it is there) of each key."""
    place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
    return place, known[place] == keys if len(known) else np.zeros(len(keys), bool)


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``perplexity`` of every row.

    Learns from the rows for which ``training`` (an expression over doc_id)
    holds; where it is null, as for null ids, a row is held out.  A null or
    empty text has its end as only token.  Repeated rows count and are scored
    each; extra columns are ignored; an empty table gives no rows; without
    training rows every word is unseen, with a probability of one."""
    rows = texts(docs).withColumn("held_out", ~F.coalesce(training, F.lit(False)))
    pairs = materialise(pair_counts(rows.filter(~F.col("held_out")).select("doc_id", "text")), "pair-counts")
    model, d, places, words, left = fit_pairs(pairs)
    p = [f"p{k}" for k in range(KINDS)]

    def weigh(batches):
        for b in batches:
            h, n = b["h"].to_numpy(), b["n"].to_numpy()
            chance = model.probabilities(h, _history(b, SWEEPS))
            yield {"h": h, "n": n, "base": model.base(n)} | {x: chance[:, k] for k, x in enumerate(p)}

    known = materialise(map_slices(words, weigh, "h long, n long, base double, " + ", ".join(f"{x} float" for x in p), WORDS), "word-scores")
    discard(*words.made_of)  # only their scores are read from here on
    discount = F.element_at(F.array(*[F.lit(float(x)) for x in d]), (_kind() + 1).cast("int"))
    # Of a context: what a customer counts, and the weight of its kind.
    places = places.select("u", "n", (1 / (STRENGTH + F.col("n"))).alias("one"),
                           ((STRENGTH + discount * F.col("tables")) / (STRENGTH + F.col("n"))).alias("above"))
    often, heavy = _frequent(places), _frequent(known)
    shared = _sent(docs, [places.filter(often).select("u", "one", "above"), known.filter(heavy).select("h", "base", *p)])
    # Tasks of so many distinct pairs, or less.
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(model.totals[0]["c1"].sum()) // DEALT)
    # Pairs of the texts meet the seating where their pairs are dealt to (by context, and those of frequent contexts one
    # by one); what lacks the chance of a rare word goes on to where its word is; sums come back to their texts.
    seating = map_slices(left, _seating_moved(shared, n), _MOVED, MOVED).union(
        map_slices(places.filter(~often), _contexts_moved(n), _MOVED, MOVED))
    moved = map_slices(rows.select("doc_id", "held_out", "text"), _texts_moved(shared, n), _MOVED)
    met = map_slices(moved.union(seating).repartitionById(n, "at"), _texts_met(shared, n), _MOVED)
    rare = map_slices(known.filter(~heavy), _words_moved(n), _MOVED, MOVED)
    found = map_slices(met.union(rare).repartitionById(n, "at"), _rare_words_met(model, n), _MOVED)
    total = materialise(map_slices(found.repartitionById(n, "at"), _texts_summed, _SCORED), "document-scores")
    return total.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


#: Rows that a task packs at a time, and characters and number of texts (their product stays below 2^63).
MOVED, SLAB, SLAB_TEXTS = 1_000_000, 10_000_000, 100_000
#: Distinct pairs that one task of the scoring holds.
DEALT = 4_000_000
_MOVED = "at int, kind int, slab long, data binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Kinds of moved rows.  A slab is what a task cut at a time; its texts go by their place in it.
_COUNTS, _PAIRS, _CONTEXTS, _TEXT_PAIRS, _WORDS, _RARE, _TEXTS, _SUMS = range(8)


def _dealt(x: np.ndarray, n: int) -> np.ndarray:
    return (mixed(x, np.full_like(x, 1)).view("u8") % np.uint64(n)).astype("i8")


def _order(at: np.ndarray, n: int, *then: np.ndarray) -> np.ndarray:
    """Order by the task below ``n``, then by a column of 64-bit numbers if given."""
    for x in then:
        order = np.argsort(x.view("u8"))
        return order[_order(at[order], n)]
    return np.argsort(at.astype(np.min_scalar_type(n)), kind="stable")


def _dealt_pairs(m: np.ndarray, u: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    return np.where(frequent, (m.view("u8") % np.uint64(n)).astype("i8"), _dealt(u, n))


def _moved(rows: list[tuple[int, int, int, bytes]]) -> dict:
    return dict(zip(("at", "kind", "slab", "data"), zip(*rows) if rows else ([],) * 4))


def _received(batches) -> dict[int, list]:
    """(slab, data) of the moved rows that a task gets, by kind."""
    out = {k: [] for k in range(8)}
    for b in batches:
        for kind, slab, data in zip(*[b[c].to_pylist() for c in ("kind", "slab", "data")]):
            out[kind].append((slab, data))
    return out


def _together(parts: list[list[np.ndarray]], *kinds: str) -> list[np.ndarray]:
    """Columns put together, in the order of the first one."""
    columns = [np.concatenate([np.zeros(0, k), *x]) for k, x in zip(kinds, zip(*parts) if parts else [[]] * len(kinds))]
    order = np.argsort(columns[0])
    return [x[order] for x in columns]


def _seating_moved(shared, n: int):
    def run(batches):
        often = shared.value[0][0]
        for b in batches:
            u, h, left = (b[x].to_numpy() for x in ("u", "h", "left"))
            m = mixed(u, h)
            at = _dealt_pairs(m, u, _found(often, u)[1], n)
            order = _order(at, n, m)
            at, m, left = at[order], m[order], left[order]
            yield _moved([(k, _PAIRS, 0, pack(steps(m[x]), *indexed(left[x]))) for k, x in grouped(at, n)])

    return run


def _contexts_moved(n: int):
    def run(batches):
        for b in batches:
            u, one, above = (b[x].to_numpy() for x in ("u", "one", "above"))
            at = _dealt(u, n)
            order = _order(at, n, u)
            at, u, one, above = at[order], u[order], one[order], above[order]
            yield _moved([(k, _CONTEXTS, 0, pack(steps(u[x]), *indexed(one[x]), *indexed(above[x]))) for k, x in grouped(at, n)])

    return run


def _words_moved(n: int):
    def run(batches):
        for b in batches:
            h, base = b["h"].to_numpy(), b["base"].to_numpy()
            chance = np.stack([b[f"p{k}"].to_numpy() for k in range(KINDS)], axis=1)
            at = _dealt(h, n)
            order = np.lexsort((chance[:, 4], chance[:, 2], base, at))  # words of the same numbers side by side
            at, h, base, chance = at[order], h[order], base[order], chance[order]
            yield _moved([(k, _WORDS, 0, pack(h[x], base[x], *[c[x] for c in chance.T])) for k, x in grouped(at, n)])

    return run


def _texts_moved(shared, n: int):
    """Distinct pairs of the texts of a slab, with the texts they are in, and a row of the texts' own numbers."""

    def slab(held, number):
        often, (heavy, base, *_) = shared.value[0][0], shared.value[1]
        docs, held_out, texts_ = zip(*held)
        sizes, word, context, h, u = cut(list(texts_))
        texts_n = len(docs)
        doc = np.repeat(np.arange(texts_n), sizes)
        at_h, has_h = _found(heavy, h)
        known = np.bincount(doc, has_h[word], texts_n).astype("i8")
        own = np.bincount(doc, np.where(has_h, base[at_h], 0.0)[word], texts_n) if len(heavy) else np.zeros(texts_n)
        yield number % n, _TEXTS, number, pack(np.array([x or 0 for x in docs], "i8"), np.array([x is None for x in docs]), np.array(held_out), sizes, known, own)
        # Contexts in the order of their codes; one sort brings pairs and their texts together.
        at_u, has_u = _found(often, u)
        code = np.where(has_u, at_u, len(often))
        by = np.lexsort((u.view("u8"), code))
        rank = np.empty(len(u), "i8")
        rank[by] = np.arange(len(u))
        key = np.sort((rank[context] * len(h) + word) * texts_n + doc)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        freq, key = np.diff(first, append=len(key)), key[first]
        pair = key // texts_n
        doc = key - pair * texts_n
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        texts_of, pair = np.diff(first, append=len(pair)), pair[first]
        context = pair // len(h)
        word = pair - context * len(h)
        context = by[context]
        at, spread = _dealt(u, n)[context], np.flatnonzero(has_u[context])
        at[spread] = (mixed(u[context[spread]], h[word[spread]]).view("u8") % np.uint64(n)).astype("i8")
        order = _order(np.repeat(at, texts_of), n)
        doc, freq, order = doc[order], freq[order], _order(at, n)
        at, texts_of, u, h, code, at_h = at[order], texts_of[order], u[context[order]], h[word[order]], code[context[order]], np.where(has_h, at_h, len(heavy))[word[order]]
        ends, word, texts_n = np.concatenate([[0], np.cumsum(texts_of)]), at_h, [texts_n]
        for k, x in grouped(at, n):
            y = slice(ends[x.start], ends[x.stop])
            yield k, _TEXT_PAIRS, number, pack(np.array(texts_n), steps(code[x]), steps(u[x][code[x] == len(often)]), word[x], h[x][word[x] == len(heavy)],
                                               texts_of[x] - 1, doc[y], freq[y] - 1)

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0
        for b in batches:
            for doc, held_out, x in zip(*[b[c].to_pylist() for c in ("doc_id", "held_out", "text")]):
                if held and (size + len(x) > SLAB or len(held) == SLAB_TEXTS):
                    yield _moved(list(slab(held, number)))
                    number, held, size = number + 1, [], 0
                held.append((doc, held_out, x))
                size += len(x)
        if held:
            yield _moved(list(slab(held, number)))

    return run


def _texts_met(shared, n: int):
    """Sums of the scores of a slab's pairs; what has a rare word goes on."""

    def run(batches):
        (often, one_of, above_of), (heavy, _, *ps) = shared.value
        ps = np.stack(ps, axis=1)
        got = _received(batches)
        yield _moved([(slab % n, _TEXTS, slab, data) for slab, data in got[_TEXTS]])
        seated, left_of = _together([(summed(m), values[place]) for m, values, place in (unpack(x) for _, x in got[_PAIRS])], "i8", "f8")
        rare_u, rare_one, rare_above = _together(
            [(summed(u), o[i], a[j]) for u, o, i, a, j in (unpack(x) for _, x in got[_CONTEXTS])], "i8", "f8", "f8")
        further, slabs = [], []
        for slab, data in got[_TEXT_PAIRS]:
            (size,), code, rest_u, word, rest_h, texts_of, doc, freq = unpack(data)
            code, texts_of, freq = summed(code), texts_of + 1, freq + 1
            has_u, has_h = code < len(often), word < len(heavy)
            u, h, one, above = (np.empty(len(code), k) for k in ("i8", "i8", "f8", "f8"))
            u[has_u], one[has_u], above[has_u] = (x[code[has_u]] for x in (often, one_of, above_of))
            u[~has_u] = rest = summed(rest_u)
            place, there = _found(rare_u, rest)
            one[~has_u], above[~has_u] = (np.where(there, x[place], y) if len(x) else np.full(len(rest), y) for x, y in ((rare_one, 0.0), (rare_above, 1.0)))
            h[has_h], h[~has_h] = heavy[word[has_h]], rest_h
            place, there = _found(seated, mixed(u, h))
            mine = np.where(there, left_of[place], 0.0) * one if len(seated) else np.zeros(len(u))
            logs = np.zeros(len(u))
            logs[has_h] = np.log10(mine[has_h] + above[has_h] * ps[word[has_h], u[has_h] & 7])
            score = np.bincount(doc, freq * np.repeat(logs, texts_of), size)
            yield _moved([(slab % n, _SUMS, slab, pack(score, np.zeros(size), np.zeros(size, "i8")))])
            of = np.repeat(np.arange(len(u)), texts_of)
            if len(x := np.flatnonzero(~has_h[of])):
                of = of[x]
                further.append((h[of], u[of] & 7, mine[of], above[of], np.full(len(of), len(slabs)), doc[x], freq[x]))
                slabs.append((slab, size))
        if further:
            columns = [np.concatenate(x) for x in zip(*further)]
            at = _dealt(columns[0], n)
            order = _order(at, n, columns[0])
            at, (h, *columns) = at[order], [x[order] for x in columns]
            names, sizes = (np.array(x, "i8") for x in zip(*slabs))
            for k, x in grouped(at, n):
                _, kind, mine, above, of, doc, freq = h, *[c[x] for c in columns]
                yield _moved([(k, _RARE, 0, pack(names, sizes, steps(h[x]), kind, *indexed(mine), *indexed(above), of, doc, freq))])

    return run


def _added(sums: dict, slab: int, *columns: np.ndarray) -> None:
    sums[slab] = [a + b for a, b in zip(sums[slab], columns)] if slab in sums else list(columns)


def _rare_words_met(model: Model, n: int):
    """Sums of what has a rare word, by slab."""

    def run(batches):
        got, sums = _received(batches), {}
        yield _moved([(slab % n, _TEXTS, slab, data) for slab, data in got[_TEXTS]])
        for slab, data in got[_SUMS]:
            _added(sums, slab, *unpack(data))
        known, base_of, *ps = _together([unpack(x) for _, x in got[_WORDS]], "i8", "f8", *["f4"] * KINDS)
        ps, unseen, lowest = np.stack(ps, axis=1), model.unseen(), float(model.base(np.array(0)))
        for _, data in got[_RARE]:
            names, sizes, h, kind, m, i, a, j, of, doc, freq = unpack(data)
            place, there = _found(known, summed(h))
            chance, base = unseen[kind], np.full(len(h), lowest)
            chance[there], base[there] = ps[place[there], kind[there]], base_of[place[there]]
            score = freq * np.log10(m[i] + a[j] * chance)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = ends[of] + doc
            all_ = [np.bincount(at, x, ends[-1]) for x in (score, freq * base, freq * there)]
            for k, slab in enumerate(names.tolist()):
                s, b, c = (x[ends[k]:ends[k + 1]] for x in all_)
                _added(sums, slab, s, b, c.astype("i8"))
        for slab, columns in sums.items():
            yield _moved([(slab % n, _SUMS, slab, pack(*columns))])

    return run


def _texts_summed(batches):
    got, sums = _received(batches), {}
    for slab, data in got[_SUMS]:
        _added(sums, slab, *unpack(data))
    for slab, data in got[_TEXTS]:
        doc, null, held_out, size, known, base = unpack(data)
        score, more_base, more_known = sums[slab]
        yield {"doc_id": [None if x else d for d, x in zip(doc.tolist(), null.tolist())], "held_out": held_out, "n_tokens": size,
               "n_known": known + more_known, "base_score": base + more_base, "score": score}
