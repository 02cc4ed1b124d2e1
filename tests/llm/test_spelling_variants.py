import random
import re
import zlib
from collections import Counter

import pytest

from sparkweave.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string"


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if abs(len(u) - len(v)) != 1:
        return False
    s, w = sorted((u, v), key=len)
    return any(s == w[:i] + w[i + 1:] for i in range(len(w)))


def words_of(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def want(n):
    found, form = {}, {}
    for w in n:
        found[w] = [v for v in n if near(w, v)]
        best = min(found[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(found[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def random_rows(seed, n_words, letters="abéþ"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n_words)]
    rows = []
    for i in range(200):
        text = []
        for _ in range(rng.randint(0, 60)):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.5:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1:]])
            text.append(rng.choice([w, w.upper(), w.title()]))
        rows.append((i if i % 9 else None, rng.choice([" ", ", ", "1", "\n"]).join(text)))
    return rows + [(7, None), (8, ""), (9, "short ab 12345678"), (None, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = random_rows(seed, 60)
    n = words_of(rows)
    assert len(n) > 100
    assert got(sv.variants(spark.createDataFrame(rows, SCHEMA).repartition(3))) == want(n)


def test_groups_that_are_too_full_are_halved_again(spark, monkeypatch):
    """Every word starts (or ends) with the same half: the third of all words
    that shares it is dealt by its rest, and no near pair is lost."""
    rng = random.Random(5)
    words = {"prefix" + "".join(rng.choice("abc") for _ in range(k)) for k in (5, 6) for _ in range(250)}
    words |= {"".join(rng.choice("xyz") for _ in range(k)) + "suffix" for k in (5, 6) for _ in range(250)}
    rows = [(w, rng.randint(5, 500)) for w in words]
    monkeypatch.setattr(sv, "GROUP", 8)
    monkeypatch.setattr(sv, "SHARD", 900)
    found = sv.near_words(spark.createDataFrame(rows, "word string, n long")).collect()
    assert len(found) == len({(r.word, r.other) for r in found})
    assert {(r.word, r.other) for r in found} == {(u, v) for u in words for v in words if near(u, v)}
    n = dict(rows)
    assert all(r.n == n[r.word] and r.other_n == n[r.other] for r in found)


def test_short_and_long_words(spark):
    words = ["a", "b", "ab", "ba", "abc", "x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, "z"]
    found = sv.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect()
    assert {(r.word, r.other) for r in found} == {(u, v) for u in words for v in words if near(u, v)}


def test_index_intervals_are_those_of_the_text():
    words = ["banana", "bandana", "cabana", "anaban"]
    index = sv.BidirectionalIndex(words)
    text = "$" + "$".join(words)
    around = sorted(text[i:] + text[:i] for i in range(len(text)))
    assert [around[r][-1] for r in range(len(text))] == ["$" if c == 0 else chr(index.alphabet[c - 1]) for c in index.left.rows]
    q = {w: i for i, w in enumerate(words)}
    pairs = [index.near(sv.np.array([q["banana"]]), sv.np.array([3]), side) for side in (True, False)]
    assert [(a.tolist(), b.tolist()) for a, b in pairs] == [([q["banana"]], [q["bandana"]])] * 2


def test_ties_nulls_repeats_and_empty(spark):
    # "garden" is near "gardens" and "warden", both 25 times: the first in order is its form.
    text = " ".join(["garden"] * 5 + ["gardens"] * 25 + ["warden"] * 25)
    rows = [(1, text, "x", 1), (None, None, None, None), (2, "", "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    n = words_of([r[:2] for r in rows])
    assert got(sv.variants(df)) == want(n)
    twice = df.union(df)
    assert got(sv.variants(twice)) == want(words_of([r[:2] for r in rows + rows]))
    empty = sv.variants(df.limit(0))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.count() == 0
