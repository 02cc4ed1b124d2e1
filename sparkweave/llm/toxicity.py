"""Toxicity by a weighted lexicon over folded text.

Texts are folded (lower case, look-alike letters and full-width forms to their
Latin letters, digits and signs that stand for letters to those, invisible
characters dropped) and matched once by an Aho-Corasick automaton that holds
the lexicon and the exception phrases; a match inside an exception phrase does
not count.  Entries are whole words or stems (beginnings of words).

The lexicon is learned from a bounded labelled sample, in which a text counts
once however many copies it has.  Words and word
beginnings that stand in toxic documents only, after many different words, are
taken at once; other frequent ones compete to cover the toxic documents that
are not covered yet, so that what merely occurs in copies of a covered document
is not taken.  An entry's weight is its log-odds ratio.  A logistic
curve over the summed weights, plain and by the length of the text, turns
matches into a score.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import append_columns, by_position, map_slices, materialise
from sparkweave.llm.labelled import labelled_sample

PER_CLASS = 4000  # documents of a class in the training sample
LIFT = 12.0  # least ratio of an entry's rates
STEMS = (4, 5, 6, 7)
SURE = 25  # different words before a term, and ratio of its rates, from which it is taken at once
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass",
           "bastard", "asshole", "bitch", "retard", "shithead", "fuck", "cunt", "whore", "slut", "vermin")
EXCEPTIONS = ("idiot proof", "idiot-proof", "pond scum", "worthless cheque", "trash can", "trash collection", "circus clown", "clown fish")
PRIOR = 4.0  # weight of an insult that the sample doesn't know

#: Letters that look like Latin ones, and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ѡ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s",
    "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None, "­": None,
}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> str:
    return text.lower().translate(_FOLD)


def terms(text: str) -> set[tuple[str, bool]]:
    """Words and word beginnings (flagged) of a folded text."""
    found = {(w, False) for w in _WORD.findall(text)}
    return found | {(w[:n], True) for w, _ in found for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    """``entries``: (term, stem?, weight); ``curve``: of the score."""

    entries: tuple[tuple[str, bool, float], ...]
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        import ahocorasick

        out, known = ahocorasick.Automaton(), {}
        for term, stem, weight in self.entries:
            known.setdefault(term, {})[stem] = weight
        for phrase in self.exceptions:
            known.setdefault(folded(phrase), {})[None] = 0.0
        for term, kinds in known.items():
            out.add_word(term, (len(term), kinds))
        out.make_automaton()
        return out


def matched(automaton, text: str) -> tuple[float, int]:
    """(sum of weights, number) of the lexicon's matches in a folded text;
    where entries begin at the same place, the heaviest counts."""
    hits, spared = {}, []
    for end, (n, kinds) in automaton.iter(text):
        start = end - n + 1
        if start and text[start - 1].isalpha():
            continue
        closed = end + 1 == len(text) or not text[end + 1].isalpha()
        for stem, weight in kinds.items():
            if stem is None:
                if closed:
                    spared.append((start, end))
            elif stem or closed:
                hits[start] = max(weight, hits.get(start, 0.0))
    for a, b in spared:
        hits = {s: w for s, w in hits.items() if not a <= s <= b}
    return sum(hits.values()), len(hits)


def features(weight: float, text: str) -> tuple[float, float]:
    """What the curve sees: summed weight, plain and per hundred words."""
    return float(np.log1p(weight)), float(np.log1p(100 * weight / (len(text.split()) + 1)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: Column | None = None, per_class: int = PER_CLASS) -> Lexicon:
    """Lexicon and curve from a labelled sample; without labels of both classes,
    the plain insults with the prior weight."""
    sample = labelled_sample(docs, labels, label, per_class, rows).groupBy("label", "text").agg(F.min("doc_id").alias("doc_id"))
    sample = materialise(sample, "toxicity-sample")
    sizes = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    plain = Lexicon(tuple((w, False, PRIOR) for w in INSULTS))
    if not n_toxic or not n_clean:
        return plain

    def tally(batches):
        for b in batches:
            seen = {0: Counter(), 1: Counter()}
            for y, x in zip(b["label"].to_pylist(), b["text"].to_pylist()):
                seen[y].update(terms(folded(x)))
            every = list(seen[0].keys() | seen[1].keys())
            yield {"term": [t for t, _ in every], "stem": [s for _, s in every],
                   "toxic": [seen[1][t] for t in every], "clean": [seen[0][t] for t in every]}

    counts = (map_slices(sample.select("label", "text"), tally, "term string, stem boolean, toxic long, clean long")
              .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    lift = (F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(3, n_toxic // 400)
    found = counts.filter(((F.col("toxic") >= least) & (lift >= LIFT)) | (~F.col("stem") & F.col("term").isin(*INSULTS))).collect()
    candidates = {(r.term, r.stem): (r.toxic, r.clean) for r in found}

    def incidence(batches):
        for b in batches:
            out = []
            for doc, x in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ws = ["", *_WORD.findall(folded(x))]
                out += {(t, s, doc, before) for before, w in zip(ws, ws[1:])
                        for t, s in [(w, False)] + [(w[:n], True) for n in STEMS if len(w) > n] if (t, s) in candidates}
            yield dict(zip(("term", "stem", "doc", "before"), zip(*out))) if out else {"term": [], "stem": [], "doc": [], "before": []}

    places = map_slices(sample.filter("label = 1").select("doc_id", "text"), incidence, "term string, stem boolean, doc long, before string")
    places = materialise(places.groupBy("term", "stem").agg(
        F.sort_array(F.collect_set("doc")).alias("docs"), F.count_distinct("before").alias("befores")), "toxicity-terms")
    # Surely toxic: hardly ever in clean documents, and after too many different words to be from copies.
    sure = [t for r in places.filter(F.col("befores") >= SURE).select("term", "stem").collect()
            if candidates[t := (r.term, r.stem)][1] * n_toxic * SURE <= candidates[t][0] * n_clean]
    chosen = _narrowed(sure, candidates)
    covered = {d for r in places.filter(F.col("befores") >= SURE).collect() if (r.term, r.stem) in set(chosen) for d in r.docs}
    # Of terms in the same documents only one can be taken: the last in order.
    alike = (places.join(counts.select("term", "stem", "clean"), ["term", "stem"]).groupBy("docs", "clean")
             .agg(F.max(F.struct(F.length("term").alias("n"), "term", "stem")).alias("t")))
    covers = {(r.t.term, r.t.stem): set(r.docs) for r in alike.collect()}
    chosen += _covering({t: d for t, d in covers.items() if t not in set(chosen)}, candidates, covered, least)
    weigh = lambda t: float(np.log((candidates[t][0] + 0.5) / (n_toxic + 1) / ((candidates[t][1] + 0.5) / (n_clean + 1))))
    entries = {t: weigh(t) for t in chosen} | {(w, False): PRIOR for w in INSULTS if (w, False) not in candidates}
    entries |= {(w, False): weigh((w, False)) for w in INSULTS if (w, False) in candidates and weigh((w, False)) > 0}
    lexicon = Lexicon(tuple((t, s, w) for (t, s), w in sorted(entries.items())))

    def measured(batches):
        automaton = lexicon.automaton()
        for b in batches:
            pairs = [features(matched(automaton, y := folded(x))[0], y) for x in b["text"].to_pylist()]
            yield {"label": b["label"], "a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

    seen = map_slices(sample.select("label", "text"), measured, "label int, a double, b double").collect()
    y = np.array([r.label for r in seen], float)
    x = np.array([(1.0, r.a, r.b) for r in seen])
    return Lexicon(lexicon.entries, _logistic(x, y))


def _covering(covers: dict[tuple[str, bool], set[int]], counts: dict[tuple[str, bool], tuple[int, int]], covered: set[int],
              least: int) -> list[tuple[str, bool]]:
    """Terms that, one after another, cover most documents not covered yet, less
    twice their clean ones, as long as that is ``least``.  What a term gains
    only falls, so a gain is reckoned anew when it comes first."""
    order, covered, chosen = sorted(covers, key=lambda t: (len(t[0]), t)), set(covered), []
    gain = lambda t: len(covers[t] - covered) - 2 * counts[t][1]
    heap = [(-g, -i) for i, t in enumerate(order) if (g := gain(t)) >= least]
    heapq.heapify(heap)
    while heap:
        t = order[-heap[0][1]]
        if (g := gain(t)) == -heap[0][0]:
            heapq.heappop(heap)
            chosen.append(t)
            covered |= covers[t]
        elif g >= least:
            heapq.heapreplace(heap, (-g, heap[0][1]))
        else:
            heapq.heappop(heap)
    return chosen


def _narrowed(found: list[tuple[str, bool]], counts: dict[tuple[str, bool], tuple[int, int]]) -> list[tuple[str, bool]]:
    """Without beginnings that a longer term explains (nine tenths of their
    documents), and then without terms that a remaining beginning covers."""
    order = sorted(found)
    names = [t for t, _ in order]

    def explained(t):
        at = bisect_left(names, t[0])
        while at < len(order) and names[at].startswith(t[0]):
            u = order[at]
            if u != t and (len(u[0]) > len(t[0]) or not u[1]) and 10 * counts[u][0] >= 9 * counts[t][0]:
                return True
            at += 1
        return False

    longer = [t for t in found if not (t[1] and explained(t))]
    stems = {t for t, s in longer if s}
    return sorted((t for t in longer if not any(t[0][:n] in stems and (len(t[0]) > n or not t[1]) for n in range(1, len(t[0]) + 1))),
                  key=lambda t: (-counts[t][0], t))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float, float]:
    """Penalised logistic regression by Newton steps; no weight of a match is negative."""
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + penalty * w
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), grad)
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def accepted(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Rows of ``docs`` with all their columns, whatever they are called, that the
    lexicon does not predict as toxic."""
    return by_position(docs, lambda d: with_scores(d, lexicon).filter("__predicted = 0").select(*d.columns), "text")


def with_scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """All rows and columns of ``docs``, and ``__score`` (0 to 1),
    ``__predicted`` (1 from a half on) and ``__matches``.

    A null or empty text matches nothing and gets the lowest score.  Repeated
    rows and null ids are scored row by row; an empty table gives no rows;
    texts are matched whole."""

    def make():
        automaton, curve = lexicon.automaton(), lexicon.curve

        def run(documents):
            scores, n = [], []
            for x in documents:
                y = folded(x)
                weight, hits = matched(automaton, y)
                at = curve[0] + float(np.dot(curve[1:], features(weight, y)))
                scores.append(1 / (1 + float(np.exp(-np.clip(at, -30, 30)))))
                n.append(hits)
            return {"__score": scores, "__predicted": [int(s >= 0.5) for s in scores], "__matches": n}

        return run

    return append_columns(docs, make, "__score double, __predicted int, __matches long")
