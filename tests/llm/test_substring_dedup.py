import random
from collections import Counter

import numpy as np
import pytest

from sparkweave.llm import substring_dedup as sd
from tests.llm import brute


def words(text):
    return [w.decode() for w in (text or "").encode().split()]


def want(rows, window):
    cut = [(doc, words(text)) for doc, text in rows]
    seen = Counter(tuple(w[i:i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for doc, w in cut:
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if doc is None else doc, len(w), len(gone), brute.sha(kept)))
    return sorted(out)


def got(spark, rows, window, parts=4):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id long, text string, row int, places string, pos int").repartition(parts)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in sd.removal_report(df, window).collect())


@pytest.mark.parametrize("period", sd.COVERS)
def test_covers(period):
    """Any two places have an offset that brings both into the cover."""
    cover = set(sd.COVERS[period])
    assert all(any((i + d) % period in cover and (j + d) % period in cover for d in range(period)) for i in range(period) for j in range(period))


@pytest.mark.parametrize(("window", "seed"), [(35, 1), (35, 2), (12, 3), (5, 4), (2, 5), (1, 6)])
def test_equals_brute_force(spark, window, seed):
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}" + rng.choice(["", "", ".", "é"])
    passages = [[word(5000) for _ in range(rng.randint(max(1, window - 3), window * 2 + 3))] for _ in range(12)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages) if rng.random() < 0.6 else [word(10**6) for _ in range(rng.randint(1, 60))]
            if rng.random() < 0.4:
                part = part[rng.randrange(3):len(part) - rng.randrange(3)]
            text += part
        rows.append((rng.choice([i, i, None, 7]), rng.choice([" ", "\n", " \t"]).join(text)))
    assert got(spark, rows, window) == want(rows, window)


@pytest.mark.parametrize("together", [1, sd.TOGETHER])
def test_hot_passage_and_copies(spark, monkeypatch, together):
    """A third of the rows are one text, others share one passage of exactly a
    window, wherever it starts; what a task meets together changes nothing."""
    monkeypatch.setattr(sd, "TOGETHER", together)
    passage = [f"p{i}" for i in range(35)]
    copy = " ".join(f"c{i}" for i in range(80))
    rows = [(i, copy) for i in range(60)]
    for i in range(60):
        rows.append((100 + i, " ".join([f"a{i}.{j}" for j in range(i % 23)] + passage + [f"b{i}.{j}" for j in range(i % 5)])))
    rows += [(300 + i, " ".join([f"q{i}.{j}" for j in range(i)] + passage[:34])) for i in range(20)]  # a word short
    result = got(spark, rows, 35, parts=7)
    assert result == want(rows, 35)
    by_id = {r[0]: r for r in result}
    assert all(by_id[i][2] == 80 for i in range(60)) and all(by_id[100 + i][2] == 35 for i in range(60)) and all(by_id[300 + i][2] == 0 for i in range(20))


def test_hot_keys_stay_small_and_are_dealt_out():
    """Of 1,000 equal places one keeps its key; the others get keys of their own."""
    out = sd._known(np.full(1000, 42, "i8"), np.full(1000, -7, "i4"), np.arange(1000), np.zeros(1000, "i8"))
    assert (out["k0"] == 42).sum() == 1 and len(set(out["k0"].tolist())) == 1000
    assert (out["tail"] >> 31 & 1).all() and out["tail"][out["k0"] == 42] >> 32 == -7
    alone = sd._known(np.arange(5), np.zeros(5, "i4"), np.arange(5), np.arange(5))
    assert alone["k0"].tolist() == alone["tail"].tolist() == list(range(5))


def test_within_one_text_overlapping_and_long(spark):
    rows = [(1, "same " * 100), (2, "same " * 34), (3, "same " * 35), (4, " ".join(f"w{i % 40}" for i in range(200))),
            (5, " ".join(f"u{i}" for i in range(60_000))), (6, " ".join(f"u{i}" for i in range(59_000, 59_040))), (7, None), (8, ""), (None, " \n\t "),
            (9, "x\x1cy z " * 40)]
    assert got(spark, rows, 35) == want(rows, 35)
    assert got(spark, rows + rows, 35) == want(rows + rows, 35)
    assert got(spark, [], 35) == []


def test_kept_text(spark):
    rows = [(1, "a  b c\n" + " ".join(f"p{i}" for i in range(35)) + " d"), (2, " ".join(f"p{i}" for i in range(35)))]
    result = {r.doc_id: r.text for r in sd.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert result == {1: "a b c d", 2: ""}
