import numpy as np
import pytest

from sparkweave.llm import embedding_dedup as ed
from tests.llm import brute


def want(rows, threshold=0.98):
    """By position: (n_links, component) under brute force."""
    ok = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for x, a in enumerate(ok):
        for b in ok[x + 1:]:
            (_, u, p), (_, v, q) = rows[a], rows[b]
            if p == q and len(u) == len(v):
                u, v = np.array(u, float), np.array(v, float)
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    links.append((a, b))
    root = brute.components(range(len(rows)), links)
    degree = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    least = {}
    for i, (vec, _, _) in enumerate(rows):
        if vec is not None:
            least[root[i]] = min(vec, least.get(root[i], vec))
    return [(r[0], int(degree[i]), least.get(root[i]), r[0] == least.get(root[i])) for i, r in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, ed.near_duplicates(df).collect()), key=key) == sorted(want(rows), key=key)


def test_given_vectors(spark):
    for r in (spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"),):
        rows = [(x.vec_id, x.embedding, x.label) for x in r.collect()]
        check(spark, rows)


@pytest.mark.parametrize("block", [8, ed.BLOCK])
def test_large_groups_over_many_cells(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rng, rows = np.random.default_rng(4), []
    centre = rng.normal(size=6)
    for i in range(260):  # a spread group that crosses cell borders, and plain vectors
        v = centre + rng.normal(size=6) * 0.12 * (i % 4) if i % 3 else rng.normal(size=6)
        rows.append((int(rng.integers(10**6)), v.tolist(), i % 2))
    rows += [(7, rows[1][1], 1)] * 3 + [(8, [2 * x for x in rows[1][1]], 1)]
    monkeypatch.setattr(ed, "CELLS", 12)
    check(spark, rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (8, [1.0, -0.0], 1), (9, [1e200, 0.0], 1), (10, [1.0, 0.0], 2), (None, [1.0, 0.0], 2), (None, [0.0, 1.0], 2),
            (11, [1.0, 0.0, 0.0], 1), (12, [1e-200, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted([tuple(-1 if x is None else x for x in r) for r in ed.near_duplicates(df).collect()])
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
                          (8, 3, 8, True), (8, 3, 8, True), (9, 3, 8, False), (12, 3, 8, False), (10, 1, 10, True), (-1, 1, 10, False),
                          (-1, 0, -1, True), (11, 0, 11, True)])
    assert ed.near_duplicates(df.limit(0)).count() == 0
