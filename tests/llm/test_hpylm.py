import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import hpylm
from sparkweave.llm.common import fold
from tests.llm import brute


def base_scores(rows):
    """By the definition: {id: (held_out, n_tokens, n_known, N, base)} as a list."""
    toks = [[*brute.words(t), None] for _, t in rows]
    held = [d is None or brute.fold(d, 5) == 1 for d, _ in rows]
    c = Counter(w for ws, h in zip(toks, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
            for (d, _), ws, h in zip(rows, toks, held)]


def check(rows, found):
    key = lambda r: (-1 if r[0] is None else r[0], r[2], r[5])
    for got, want in zip(sorted(map(tuple, found), key=key), sorted(base_scores(rows), key=key), strict=True):
        assert got[:5] == want[:5] and got[5] == pytest.approx(want[5], abs=1e-6, rel=1e-9)
        assert got[6] < 1e-9


@pytest.mark.parametrize("heavy", [16, hpylm.HEAVY])
def test_given_documents(spark, monkeypatch, heavy):
    monkeypatch.setattr(hpylm, "HEAVY", heavy)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("row", F.lit(1)).withColumn("h", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = hpylm.scores(docs, fold("doc_id", 5) != 1).collect()
    check(rows, found)
    for held in (True, False):
        mine, base = (sum(r[c] for r in found if r.held_out == held) for c in ("score", "base_score"))
        assert mine > base
    TOTALS[heavy] = sum(r.score for r in found)
    if len(TOTALS) == 2:
        a, b = TOTALS.values()
        assert a == pytest.approx(b, rel=1e-6)


TOTALS: dict = {}


def test_edges(spark):
    rows = [(0, None), (1, ""), (2, "A b. c"), (2, "A b. c"), (3, "x " * 30_000), (None, "a a"), (4, "É é 7 d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, hpylm.scores(docs, fold("doc_id", 5) != 1).collect())
    assert hpylm.scores(docs.limit(0), fold("doc_id", 5) != 1).count() == 0
    untrained = hpylm.scores(docs, F.lit(False)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untrained)


def test_probabilities_add_up(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from sparkweave.llm.common import materialise
    counts = materialise(hpylm.word_counts(docs), "counts")
    model = hpylm.fit(counts)
    pdf = counts.toPandas()
    p = model.probabilities(pdf["h"].to_numpy(), pdf[hpylm._C].to_numpy())
    assert p.min() > 0
    assert p.sum(axis=0) + model.unseen() == pytest.approx(np.ones(hpylm.KINDS), abs=1e-6)


def test_seating():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 4000)
    c = np.full(4000, 60)
    t, _ = hpylm.seat(c, np.full(4000, 0.8), 0.5, h, 3)
    plain = []
    for _ in range(4000):
        k = 1
        for n in range(1, 60):
            k += rng.random() < 0.8 / (n - 0.5 * k + 0.8)
        plain.append(k)
    assert abs(t.mean() - np.mean(plain)) < 0.15 and t.min() >= 1 and (t <= c).all()


def test_word_contexts(spark):
    """A word is likelier after the word it follows than after another of the same kind."""
    rows = [(i, ("abc one. xyz two. " if i % 2 else "xyz two. abc one. ") * 5) for i in range(40)]
    rows += [(100, "abc one. "), (101, "abc two. "), (102, "xyz two. "), (103, "nnn one. ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.score for r in hpylm.scores(docs, F.col("doc_id") < 100).collect()}
    assert found[100] > found[101] + 0.5 and found[102] > found[101] + 0.5


def test_probabilities_after_each_word_add_up(spark):
    from sparkweave.llm.common import materialise
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = materialise(hpylm.pair_counts(docs), "pairs")
    counted = Counter()
    for r in docs.select("text").collect():
        h, kinds = hpylm.tokens(r.text or "")
        counted.update(zip(hpylm.contexts(h, kinds).tolist(), h.tolist()))
    assert {(r.u, r.h): r.c for r in pairs.collect()} == counted
    model, d, places, words, left = hpylm.fit_pairs(pairs)
    pdf = words.toPandas()
    import pyarrow as pa
    history = hpylm._history(pa.Table.from_pandas(pdf), hpylm.SWEEPS)
    p = model.probabilities(pdf["h"].to_numpy(), history).sum(axis=0) + model.unseen()
    assert p == pytest.approx(np.ones(hpylm.KINDS), abs=1e-6)
    sums = left.groupBy("u").agg(F.sum("left").alias("left")).join(places, "u").collect()
    assert len(sums) == len({u for u, _ in counted})
    for r in sums:
        above = hpylm.STRENGTH + d[r.u & 7] * r.tables
        assert (r.left + above) / (hpylm.STRENGTH + r.n) == pytest.approx(1)
        assert r.tables >= 1 and r.left > 0


def test_discounts_of_the_parents(spark):
    from sparkweave.llm.common import materialise
    counts = materialise(hpylm.word_counts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), "counts")
    model = hpylm.fit(counts)
    c = counts.toPandas()[hpylm._C].to_numpy()
    for g in (0, 1):
        customers = (c[:, hpylm.PARENT == g] > 0).sum(axis=1)
        n1, n2 = (customers == 1).sum(), (customers == 2).sum()
        assert model.discounts["parent"][g] == pytest.approx(min(0.9, max(0.1, (n1 + 0.5) / (n1 + 2 * n2 + 1))))
    assert hpylm.SWEEPS >= 4 and len(model.totals) == hpylm.SWEEPS + 1


def test_score_of_a_text_recomputed_from_the_seating(spark):
    import pyarrow as pa
    from sparkweave.llm.common import materialise
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    training = fold("doc_id", 5) != 1
    found = {r.doc_id: r for r in hpylm.scores(docs, training).collect()}
    model, d, places, words, left = hpylm.fit_pairs(materialise(hpylm.pair_counts(docs.filter(training)), "pairs"))
    pdf = words.toPandas()
    chance = dict(zip(pdf["h"].tolist(), model.probabilities(pdf["h"].to_numpy(), hpylm._history(pa.Table.from_pandas(pdf), hpylm.SWEEPS))))
    context = {r.u: (r.n, r.tables) for r in places.collect()}
    seated = {(r.u, r.h): r.left for r in left.collect()}
    unseen, s = model.unseen(), hpylm.STRENGTH
    for r in docs.collect()[::7]:
        total = 0.0
        h, kinds = hpylm.tokens(r.text or "")
        for u, w, k in zip(hpylm.contexts(h, kinds).tolist(), h.tolist(), kinds.tolist()):
            p = chance[w][k] if w in chance else unseen[k]
            if u in context:
                n, tables = context[u]
                p = (seated.get((u, w), 0.0) + (s + d[k] * tables) * p) / (s + n)
            total += math.log10(p)
        assert found[r.doc_id].score == pytest.approx(total, rel=1e-5)


def test_rows_in_any_order_and_repeated(spark):
    """Rows that come in another order in every pass are not mixed up."""
    rows = [(i % 40 if i % 7 else None, f"some text number {i % 23} of {i % 3}. The end") for i in range(120)] + [(1, "twice here")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 9))
    still = sorted(map(key, hpylm.scores(docs, fold("doc_id", 5) != 1).collect()))
    shuffled = docs.withColumn("x", F.rand()).repartition(5, "x").drop("x")
    assert sorted(map(key, hpylm.scores(shuffled, fold("doc_id", 5) != 1).collect())) == still
    check(rows, hpylm.scores(docs, fold("doc_id", 5) != 1).collect())


def test_texts_are_cut_once_for_the_scores(spark):
    """The sums over frequent words and the look-ups of rare ones come from one pass over the texts."""
    docs = spark.createDataFrame([(i, f"some text number {i}. The end") for i in range(20)], "doc_id long, text string")
    plan = hpylm.scores(docs, fold("doc_id", 5) != 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the pass is over, its sums and rows are written


def test_sweeps_write_only_what_can_change(spark, monkeypatch):
    """Contexts and words whose pairs all occur once are written before the sweeps, not by each of them."""
    written = {}

    def kept(df, name, write=hpylm.materialise):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(hpylm, "materialise", kept)
    monkeypatch.setattr(hpylm, "discard", lambda *tables: None)
    docs = spark.createDataFrame([(i, f"again and again w{i} x{i}") for i in range(20)], "doc_id long, text string")
    pairs = kept(hpylm.pair_counts(docs), "pairs")
    rows = [(r.u, r.h, r.c) for r in pairs.collect()]
    for at, name in ((0, "contexts-1"), (1, "words-1")):
        assert {r[0] for r in written_rows(hpylm, written, pairs, name, "uh"[at])} == {r[at] for r in rows if r[2] > 1}
        assert len({r[at] for r in rows}) > 20


def written_rows(module, written, pairs, name, key):
    if name not in written:
        module.fit_pairs(pairs)
    return written[name].select(key).collect()


def test_scoring_moves_a_row_for_many_pairs(spark):
    """What the texts of a task send is one row for each task that is sent to, not one for each pair."""
    from sparkweave.llm.packed import unpack
    docs = spark.createDataFrame([(i, f"some text {i % 7} of words w{i} x{i}") for i in range(500)], "doc_id long, text string").coalesce(1)
    shared = hpylm._sent(docs, [spark.createDataFrame([], "u long, one double, above double"),
                                spark.createDataFrame([], "h long, base double, " + ", ".join(f"p{k} float" for k in range(hpylm.KINDS)))])
    from sparkweave.llm.common import map_slices
    moved = map_slices(docs.withColumn("held_out", F.lit(False)), hpylm._texts_moved(shared, 4), hpylm._MOVED).collect()
    assert len(moved) == 5  # the texts' own, and four tasks
    got, want = Counter(), Counter()
    for r in moved:
        if r.kind == hpylm._TEXT_PAIRS:
            _, _, u, _, h, texts_of, doc, freq = unpack(r.data)
            u = np.cumsum(u, dtype="u8").view("i8")
            for x, y, z, n in zip(np.repeat(u, texts_of + 1).tolist(), np.repeat(h, texts_of + 1).tolist(), doc.tolist(), (freq + 1).tolist()):
                got[x, y, z] += n
    for i, r in enumerate(docs.collect()):
        h, kinds = hpylm.tokens(r.text)
        want.update((x, y, i) for x, y in zip(hpylm.contexts(h, kinds).tolist(), h.tolist()))
    assert got == want


@pytest.mark.parametrize("limits", [(16, 40, 2, 300), (hpylm.HEAVY, 1, 100, 7)])
def test_cuts_do_not_matter(spark, monkeypatch, limits):
    """Neither what is broadcast nor where texts, rows and tasks are cut changes a score."""
    rows = [(i if i % 9 else None, f"Some text {i % 7}. And more {i % 23}, \u00c9 w{i % 40}" if i % 11 else None) for i in range(150)] + [(1, "x " * 3000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 7), round(r.base_score, 7), r.n_known, r.held_out)
    plain = sorted(map(key, hpylm.scores(docs, fold("doc_id", 5) != 1).collect()))
    for name, x in zip(("HEAVY", "SLAB", "SLAB_TEXTS", "GATHERED"), limits):
        monkeypatch.setattr(hpylm, name, x)
    monkeypatch.setattr(hpylm, "DEALT", 20)
    assert sorted(map(key, hpylm.scores(docs, fold("doc_id", 5) != 1).collect())) == plain


def test_pairs_are_counted_in_one_task(spark, monkeypatch):
    """A pair that many slabs of several partitions hold comes out once."""
    monkeypatch.setattr(hpylm, "GATHERED", 7)
    docs = spark.createDataFrame([(i, f"Some text {i % 7}. And more {i % 23}") for i in range(150)], "doc_id long, text string")
    often = hpylm._often(docs, 4)
    assert len(often) > 1 and (np.diff(often) > 0).all()
    pairs = [(r.u, r.h) for r in hpylm.pair_counts(docs).collect()]
    assert len(pairs) == len(set(pairs))


def test_packed_columns():
    from sparkweave.llm.packed import indexed, pack, steps, summed, unpack
    x = np.sort(np.random.default_rng(0).integers(-1 << 63, (1 << 63) - 1, 500))
    f = np.repeat([0.25, -1.5], 250)
    columns = (steps(x), np.arange(500), np.arange(-5, 495), f, *indexed(f), np.zeros(0, "i8"), np.array([True, False]))
    got = unpack(pack(*columns))
    assert (summed(got[0]) == x).all() and all((a == b).all() and len(a) == len(b) for a, b in zip(got, columns))
    assert [a.dtype for a in got] == [b.dtype for b in columns]
    assert unpack(pack(np.array([(1 << 62) + 1])))[0].dtype == "i8"  # not unsigned: with signed ones it would become a float
