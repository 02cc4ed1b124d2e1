"""Connected components of a graph given by its edges, without collecting any.

Edges are first contracted to forests inside each partition, then large-star
and small-star steps alternate until they change nothing: every node then
points to the smallest node of its component.  Each step is an aggregate of
the smallest neighbour and a join, so a node with very many edges is combined
in the tasks and split by the join; each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import discard, map_slices, materialise

#: Edges a task gathers before it emits their forest.
FOREST_EDGES = 500_000


class Forest:
    """Union-find whose roots are the smallest nodes."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = (a, b) if a < b else (b, a)
        self.parent[b] = a
        return True

    def edges(self) -> Iterable[tuple]:
        """(node, root) of every node that is no root."""
        return [(x, self.find(x)) for x in list(self.parent) if self.find(x) != x]


def _contracted(edges: DataFrame) -> DataFrame:
    def run(batches):
        forest, n = Forest(), 0
        for b in batches:
            for x, y in zip(b["u"].to_pylist(), b["v"].to_pylist()):
                forest.union(x, y)
            n += b.num_rows
            if n >= FOREST_EDGES:
                found, forest, n = forest.edges(), Forest(), 0
                yield {"u": [x for x, _ in found], "v": [y for _, y in found]}
        found = forest.edges()
        yield {"u": [x for x, _ in found], "v": [y for _, y in found]}

    return map_slices(edges, run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) of every node that
    isn't the smallest of its component.  ``edges`` has the long columns ``u``
    and ``v``; loops and repeated edges change nothing, rows with a null are
    left out, no edges give no rows."""
    state = materialise(_contracted(edges.filter("u <> v")).distinct(), "components")
    seen = None
    while True:
        n = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == seen or n[0] == 0:
            found = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
            found.written_at = state.written_at
            return found
        seen = n
        both = state.union(state.select("v", "u"))
        # Written, so that the joins get both sides from shuffles and can split a node's many edges.
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "components")
        large = materialise(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "components")
        down = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "components")
        small = (large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").filter("u <> v").distinct())
        old, state = state, materialise(small, "components")
        discard(old, least, large, down)
