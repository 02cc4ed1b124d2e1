"""Lloyd's clustering of integer vectors, its dimensions dealt out.

Kept vectors become integers and are written once as slices: ``WIDTH`` columns
of a chunk of vectors.  In a round a task has the slice of the centroids that
belongs to its columns and computes the exact partial distances of its
vectors; ``reduceByKey`` adds the blocks of a chunk and takes the nearest
centroid.  Each column block then sums its own columns by cluster and makes its
slice of the next centroids.  Only centroids (``k`` vectors) and sums by cluster
pass through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import map_slices, materialise

DIMS, K, ROUNDS, SCALE, WIDTH = 64, 16, 3, 64, 16
#: Integers up to here have squared distances that fit a long.
LARGEST = 1 << 27

SLICES = "chunk long, block int, n int, ids array<long>, data binary"
LABELS = "chunk long, ids array<long>, labels binary, distances binary"


def integer_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """``vec_id`` and ``v`` (floor(scale * x) of each component) of the vectors
    that are compared."""
    def fits(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) <= LARGEST)

    return (vectors.filter((F.size("embedding") == dims) & F.forall("embedding", fits))
            .select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")))


def packed(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold all of them."""
    least, most = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def unpacked(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (n * width)}").reshape(n, width).astype("i8")


def slices_of(integers: DataFrame, dims: int, width: int) -> DataFrame:
    """The vectors in chunks, each cut to blocks of ``width`` columns; the ids go
    with the first block."""

    def run(batches):
        first = TaskContext.get().partitionId() << 33
        for i, b in enumerate(batches):
            n = b.num_rows
            v = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, dims)
            at = range(0, dims, width)
            yield {"chunk": [first + i] * len(at), "block": list(range(len(at))), "n": [n] * len(at),
                   "ids": [None if a else b["vec_id"].to_pylist() for a in at], "data": [packed(v[:, a:a + width]) for a in at]}

    return map_slices(integers, run, SLICES)


def nearest(slices: DataFrame, centroids: np.ndarray, width: int) -> RDD:
    """(chunk, (ids, number of vectors, cluster and squared distance of each))."""
    k = len(centroids)
    blocks = [centroids[:, a:a + width] for a in range(0, centroids.shape[1], width)]

    def partial(r) -> tuple:
        c = blocks[r.block]
        x = unpacked(bytes(r.data), r.n, c.shape[1])
        distances = np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)
        return r.chunk, (r.ids, r.n, packed(distances))

    def add(p: tuple, q: tuple) -> tuple:
        return p[0] or q[0], p[1], packed(unpacked(p[2], p[1], k) + unpacked(q[2], q[1], k))

    def least(v: tuple) -> tuple:
        distances = unpacked(v[2], v[1], k)
        label = distances.argmin(axis=1)
        return v[0], label.astype("<i4").tobytes(), distances[np.arange(v[1]), label].astype("<i8").tobytes()

    return slices.rdd.map(partial).reduceByKey(add).mapValues(least)


def assigned(slices: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """Each chunk's clusters and distances, written."""
    rows = nearest(slices, centroids, width).map(lambda kv: (kv[0], *kv[1]))
    return materialise(slices.sparkSession.createDataFrame(rows, LABELS, verifySchema=False), "clusters")


def updated(slices: DataFrame, labels: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """Componentwise floor of the mean of each cluster; empty ones stay."""
    k, dims = centroids.shape

    def sums(batches):
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, n, data, raw in zip(*[b[c].to_pylist() for c in ("block", "n", "data", "labels")]):
                columns = min(width, dims - block * width)
                total, count = found.setdefault(block, (np.zeros((k, columns), "i8"), np.zeros(k, "i8")))
                label = np.frombuffer(raw, "<i4")
                np.add.at(total, label, unpacked(data, n, columns))
                count += np.bincount(label, minlength=k)
        for block, (total, count) in found.items():
            c, j = (x.ravel() for x in np.indices(total.shape))
            yield {"cluster": c, "dim": block * width + j, "total": total.ravel(), "n": count[c]}

    joined = slices.select("chunk", "block", "n", "data").join(labels.select("chunk", "labels"), "chunk")
    partial = map_slices(joined, sums, "cluster int, dim int, total long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    new = centroids.copy()
    for r in partial.groupBy("cluster", "dim").agg(exact("total"), exact("n")).filter("n > 0").collect():  # k * dims rows
        new[r.cluster, r.dim] = int(r.total) // int(r.n)
    return new


def first_centroids(integers: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``1:<vec_id>`` (null: no
    digits), equal ones in the order of their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in integers.orderBy(key, "v").limit(k).select("v").collect()], "i8")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256`` of every vector that is compared.

    Those are vectors of ``dims`` components, none null, NaN or infinite; one
    whose integers exceed 2**27 (squared distances then overflow a long) counts
    as infinite.  Null ids and repeated rows are vectors of their own; with
    fewer than ``k`` vectors each is a centroid; equal distances go to the
    smaller number; extra columns are ignored; an empty table gives no rows."""
    spark = vectors.sparkSession
    integers = integer_vectors(vectors, dims, scale)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(integers, k)
    if not len(centroids):
        return spark.createDataFrame([], out)
    slices = materialise(slices_of(integers, dims, width), "slices")
    for _ in range(rounds):
        centroids = updated(slices, assigned(slices, centroids, width), centroids, width)

    def members(batches):
        for b in batches:
            for ids, label, distance in zip(*[b[c].to_pylist() for c in ("ids", "labels", "distances")]):
                yield {"vec_id": ids, "cluster": np.frombuffer(label, "<i4"), "distance": np.frombuffer(distance, "<i8")}

    rows = map_slices(assigned(slices, centroids, width), members, "vec_id long, cluster int, distance long")
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
