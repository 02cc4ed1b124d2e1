"""Near-duplicate vectors: spherical k-means cells, blocked cosines in them.

Equal vectors with the same label form a class; what follows has one row a
class.  Cells are the centroids of spherical k-means on a bounded sample; every
class belongs to its nearest and also visits each cell whose border (the plane
between the two centroids) is within half the chord of the threshold: of two
vectors similar enough in different cells at least one visits the other's, so
no link is lost.  A cell's residents and all its rows are dealt to blocks of
about ``BLOCK``, and each block of residents with each block of rows is one
product; a pair of vectors that meets in two cells counts in the lower one.
Counts of links and a spanning forest leave a product, never its pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import map_slices, materialise, runs
from sparkweave.llm.components import components

THRESHOLD = 0.98
SAMPLE, CELLS, ROUNDS = 16_384, 1024, 8  # most sampled vectors and centroids; rounds of k-means
BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """At most ``k`` unit centroids of unit vectors."""
    centroids = x[np.random.default_rng(3).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def cells_of(x: np.ndarray, centroids: np.ndarray, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(home cell, cells to be in) of unit vectors."""
    near = x @ centroids.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
    margin = np.sqrt(2 - 2 * threshold) / 2 + 1e-6
    inside = near[np.arange(len(x)), home][:, None] - near <= margin * apart[home] + 1e-9
    inside[np.arange(len(x)), home] = True
    return home, [np.flatnonzero(r) for r in inside]


def classes_of(vectors: DataFrame) -> DataFrame:
    """``row``, ``vec_id``, ``label``, ``digest`` and ``vector`` (float64 bytes)
    of every row; the last two are null where a vector can't be compared."""

    def run(batches):
        for b in batches:
            digests, raw = [], []
            for v, label in zip(b["embedding"].to_pylist(), b["label"].to_pylist()):
                x = np.array(v, "<f8") + 0.0 if v and label is not None and None not in v else None
                if x is None or not np.isfinite(x).all() or not x.any():
                    digests.append(None)
                    raw.append(None)
                else:
                    raw.append(x.tobytes())
                    digests.append(xxhash.xxh3_128_digest(raw[-1]))
            yield {"row": b["row"], "vec_id": b["vec_id"], "label": b["label"], "digest": digests, "vector": raw}

    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string").alias("label"))
    return map_slices(rows.withColumn("row", F.monotonically_increasing_id()), run,
                      "row long, vec_id long, label string, digest binary, vector binary")


def forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest (row, column) of the graph between rows and columns."""
    edges, rows, columns = [], np.zeros(len(hit), bool), np.zeros(hit.shape[1], bool)
    for start in np.flatnonzero(hit.any(axis=1)):
        if rows[start]:
            continue
        rows[start], front = True, np.array([start])
        while len(front):
            new = np.flatnonzero(hit[front].any(axis=0) & ~columns)
            edges += zip(front[hit[np.ix_(front, new)].argmax(axis=0)].tolist(), new.tolist())
            columns[new] = True
            front = np.flatnonzero(hit[:, new].any(axis=1) & ~rows) if len(new) else new
            edges += zip(front.tolist(), new[hit[np.ix_(front, new)].argmax(axis=1)].tolist()) if len(front) else []
            rows[front] = True
    return edges


def _linked(threshold: float):
    def run(batches):
        for g in runs(batches, ("label", "dim", "cell", "i", "j")):
            x = unit(np.frombuffer(b"".join(g["vector"]), "<f8").reshape(len(g["node"]), -1))
            node, home, copies, resident = (np.array(g[c]) for c in ("node", "home", "copies", "resident"))
            r, c, cell = np.flatnonzero(resident), np.flatnonzero(~resident), g["cell"][0]
            hit = (x[r] @ x[c].T >= threshold) & (node[r][:, None] != node[c])
            guest = home[c] != cell
            # A resident of this cell and one of a lower cell meet there if the first visits it.
            for a, b in zip(*np.nonzero(hit & (home[c] < cell))):
                if int(home[c[b]]) in g["visits"][r[a]]:
                    hit[a, b] = False
            # Two residents meet twice, once for each; a guest has its links counted here as well.
            links = np.concatenate([hit @ copies[c], (copies[r] @ hit)[guest]])
            who = np.concatenate([node[r], node[c[guest]]])
            some, edges = np.flatnonzero(links), forest(hit)
            yield {"u": who[some].tolist() + [int(node[r[a]]) for a, _ in edges], "v": [None] * len(some) + [int(node[c[b]]) for _, b in edges],
                   "n": links[some].tolist() + [0] * len(edges)}

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row.

    Linked are rows with the same label, the same length and a cosine (double
    precision) of ``threshold`` or more.  A null label, a null, empty or zero
    vector or one with a null or non-finite component is linked with nothing.
    Repeated rows are rows of their own that are linked with each other; a
    component's id is its smallest vec_id, nulls apart (null where all are
    null, and then kept).  Extra columns are ignored; an empty table gives no
    rows."""
    spark = vectors.sparkSession
    rows = materialise(classes_of(vectors), "vectors")
    classes = materialise(
        rows.filter("digest IS NOT NULL").groupBy("label", "digest")
        .agg(F.min("row").alias("node"), F.min("vec_id").alias("least"), F.count("*").alias("copies"),
             F.min_by("vector", "row").alias("vector"))
        .withColumn("dim", (F.octet_length("vector") / 8).cast("int")), "vector-classes")

    n = classes.count()
    k = int(min(CELLS, max(1, n**0.5 / 8)))
    by_dim: dict[int, list[np.ndarray]] = {}
    for r in classes.orderBy("digest", "node").limit(SAMPLE).select("vector").collect():
        by_dim.setdefault(len(r.vector) // 8, []).append(np.frombuffer(r.vector, "<f8"))
    centroids = spark.sparkContext.broadcast({d: spherical_kmeans(unit(np.array(v)), k) for d, v in by_dim.items()})

    def place(batches):
        for b in batches:
            out = {c: b[c] for c in ("label", "node", "copies", "vector", "dim")} | {"home": [], "visits": []}
            for raw, d in zip(b["vector"].to_pylist(), b["dim"].to_pylist()):
                if d in centroids.value:
                    home, cells = cells_of(unit(np.frombuffer(raw, "<f8")[None]), centroids.value[d], threshold)
                    out["home"].append(int(home[0]))
                    out["visits"].append(cells[0].tolist())
                else:  # a length that the sample doesn't have is one cell
                    out["home"].append(0)
                    out["visits"].append([0])
            yield out

    placed = map_slices(classes.select("label", "node", "copies", "vector", "dim"), place,
                        "label string, node long, copies long, vector binary, dim int, home int, visits array<int>")
    inside = placed.withColumn("cell", F.explode("visits"))
    cell = ["label", "dim", "cell"]
    at_home = F.col("home") == F.col("cell")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = inside.groupBy(*cell).agg(blocks(F.count("*")).alias("n_all"), blocks(F.count(F.when(at_home, 1))).alias("n_home"))
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Residents stand against all rows of their cell: in a row of blocks as residents, and like guests in a column.
    as_resident = F.transform(every("n_all"), lambda j: F.struct(number("n_home").alias("i"), j.alias("j"), F.lit(True).alias("resident")))
    as_any = F.transform(every("n_home"), lambda i: F.struct(i.alias("i"), number("n_all").alias("j"), F.lit(False).alias("resident")))
    dealt = (inside.join(sizes.filter("n_home > 0"), cell)
             .withColumn("at", F.explode(F.when(at_home, F.concat(as_resident, as_any)).otherwise(as_any)))
             .select(*cell, "at.*", "node", "copies", "vector", "home", "visits"))
    key = [*cell, "i", "j"]
    found = materialise(map_slices(dealt.repartition(*key).sortWithinPartitions(*key), _linked(threshold),
                                   "u long, v long, n long"), "vector-links")
    links = found.filter("n > 0").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("v IS NOT NULL").select("u", "v"))

    named = (classes.select("label", "digest", "node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
             .withColumn("root", F.coalesce("component", "node")))
    # Written, so that the join gets both sides from shuffles and can split a large component.
    least = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids")
    result = named.join(least, "root").select("label", "digest", "component_id", (
        F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    compared = F.col("digest").isNotNull()
    component = F.when(compared, F.col("component_id")).otherwise(F.col("vec_id"))
    return (rows.select("vec_id", "label", "digest").join(result, ["label", "digest"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                    F.col("vec_id").eqNullSafe(component).alias("kept")))
