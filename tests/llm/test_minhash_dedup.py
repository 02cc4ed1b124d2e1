import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.llm import minhash_dedup as md
from sparkweave.llm.components import components
from tests.llm import brute


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    """A large group of copies edited to a varying degree, and small groups."""
    rng, out = random.Random(5), {}
    for size, length in [(400, 150)] + [(6, 60)] * 30:
        base = [f"b{rng.randrange(10**5)}" for _ in range(length)]
        for _ in range(size):
            out[len(out) * 3 + 1] = edited(rng, base, rng.randrange(0, max(1, length // 18)))
    return out


def result(df):
    return {r.doc_id: (r.component_id, r.kept) for r in df.collect()}


def test_groups_of_near_copies(spark, copies):
    rows = list(copies.items())
    random.Random(1).shuffle(rows)
    found = result(md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 4))
    want = brute.near_duplicates(copies)
    assert len(set(want.values())) < len(copies) / 2
    assert found == {i: (c, c == i) for i, c in want.items()}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute.near_duplicates(texts)
    rows = md.near_duplicates(docs, 4).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in rows} == {
        i: (c, len(brute.shingles(texts[i]))) for i, c in want.items()}


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(5, None), (4, ""), (3, " \n"), (9, "One two"), (8, "one TWO"), (7, "one two three four"), (6, "one two three"),
            (2, "É é"), (12, "é é"), (20, long), (21, long + " y"), (9, "one two"), (None, "one two"), (None, "alone here"), (9, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(0)).withColumn("cluster", F.lit("c"))
    rows = md.near_duplicates(docs, 4).collect()
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in rows))
    assert got == sorted([
        (5, 5, 0, True), (4, 4, 0, True), (3, 3, 0, True), (9, 8, 1, False), (8, 8, 1, True), (7, 7, 1, True), (6, 6, 1, True),
        (2, 2, 1, True), (12, 12, 1, True), (20, 20, 29_997, True), (21, 20, 29_998, False), (9, 8, 1, False), (-1, 8, 1, False),
        (-1, -1, 1, True), (9, 9, 1, True)])
    assert md.near_duplicates(docs.limit(0), 4).count() == 0


def test_estimate():
    rng = np.random.default_rng(0)
    m = md._multipliers(md.ROWS * md.BANDS)
    for j in (0.5, 0.8, 0.9):
        n = 2000
        common = int(2 * n * j / (1 + j))
        whole = rng.integers(0, 1 << 63, 2 * n, dtype="u8")
        a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[:common], whole[n:2 * n - common]]))
        ra, rb = md.registers(a, m), md.registers(b, m)
        assert (md.registers(np.union1d(a, b), m) == np.maximum(ra, rb)).all()
        may, estimate = md.plausible(ra, len(a), rb[None], np.array([len(b)]), 0.8)
        assert abs(estimate[0] - j) < 0.09 and may[0] == (j > 0.6)


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (7, 7), (9, 8)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 300)],
                                   [(i % 17 * 100 + 5, i) for i in range(800)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = brute.components({x for e in edges for x in e}, edges)
    assert {r.node: r.component for r in components(df).collect()} == {x: c for x, c in want.items() if x != c}
