import hashlib
import math
import random

import pytest

from sparkweave.llm import centroid_clustering as cc


def want(rows, k=16, rounds=3, dims=64):
    kept = []
    for vec, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) <= 2**27 for x in v):
            kept.append((vec, [math.floor(64 * x) for x in v]))
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), j in zip(kept, of) if j == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    final = [nearest(v) for _, v in kept]
    inertia = [sum(d for d, c in final if c == i) for i in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((-1 if vec is None else vec, c, d, inertia[c], sum(inertia), sha[c]) for (vec, _), (d, c) in zip(kept, final))


def got(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, *r[1:]) for r in df.collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(v, e, "x", 0) for v, e in rows], f"vec_id long, embedding array<{kind}>, cluster string, distance int")


def test_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert got(cc.cluster(df)) == want([(r.vec_id, r.embedding) for r in df.collect()])


@pytest.mark.parametrize("width", [1, 7, 64])
def test_any_width_gives_the_same(spark, width):
    rng = random.Random(width)
    rows = [(i % 90, [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-2, 5) for _ in range(64)]) for i in range(120)]
    df = frame(spark, rows, "double").repartition(5)
    assert got(cc.cluster(df, width=width)) == want(rows)


def test_ties_repeats_and_what_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0] * 64
    rows = [(i, [float(i % 3)] * 64) for i in range(40)] + [(5, one), (5, one), (None, one), (None, [0.0] * 64), (6, None), (7, []), (8, [1.0] * 63),
            (9, [None] + one[1:]), (10, [nan] + one[1:]), (11, [inf] + one[1:]), (12, one + [1.0]), (13, [-0.01] * 64), (14, [1e30] + one[1:]),
            (15, [2.0**21] * 64), (16, [-(2.0**21)] * 64)]
    result = got(cc.cluster(frame(spark, rows, "double")))
    assert result == want(rows) and not {6, 7, 8, 9, 10, 11, 12, 14} & {r[0] for r in result if r[0] > 5 and r[0] not in range(40)}


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    assert got(cc.cluster(frame(spark, rows))) == want(rows)
    empty = cc.cluster(frame(spark, []))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
