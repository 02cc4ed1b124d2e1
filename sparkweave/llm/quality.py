"""Text quality by a factorisation machine.

A document is a sparse vector: hashed words with their share of the text,
structure statistics, and hashed metadata values where columns are named.  The
machine scores it by a bias, a weight a feature and the inner products of low
rank vectors of all feature pairs; the sum over pairs is half of the squared
sum less the sum of squares, so a score costs one pass over the features.  It
is trained by AdaGrad on a bounded labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.llm.common import append_columns, by_position, map_slices, word_hash, words
from sparkweave.llm.labelled import labelled_sample

PER_CLASS = 3000  # documents of a class in the training sample
HASHED, RANK = 1 << 15, 8  # hashed features; length of their vectors
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.05, 1e-4

_CLASSES = np.zeros((8, 256))
for _row, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\f\v", b"!?", b".,;:'\"-()", range(128, 256))):
    _CLASSES[_row, list(_bytes)] = 1
_CLASSES[7] = 1 - _CLASSES[:7].sum(axis=0)  # other signs
STATISTICS = 15


def statistics(text: str, ws: list[bytes]) -> np.ndarray:
    """Structure of a text: shares of byte classes, word and line statistics."""
    data = text.encode("utf-8", "surrogatepass")
    share = _CLASSES @ np.bincount(np.frombuffer(data, "u1"), minlength=256) / max(1, len(data))
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(1, len(ws))
    return np.array([
        *share, np.log1p(len(ws)), len(set(ws)) / n, sum(map(len, ws)) / n / 10,
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(not w[-1:].isalpha() for w in ws) / n, sum(len(w) < 2 for w in ws) / n])


def hashed(ws: list[bytes], extra: list[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed features, values): words by the root of their share,
    metadata values by one."""
    h = np.fromiter(map(word_hash, ws), "u8", len(ws)) % HASHED
    at, n = np.unique(h.astype("i4"), return_counts=True)
    value = np.sqrt(n / max(1, len(ws)))
    if extra:
        more = np.array([word_hash(x.encode()) % HASHED for x in extra], "i4")
        at, value = np.concatenate([at, more]), np.concatenate([value, np.ones(len(more))])
    return at, value.astype("f4")


@dataclass
class Machine:
    """Weights of the hashed features, then of the statistics."""

    bias: float
    weight: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, at: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        return np.concatenate([at, HASHED + np.arange(STATISTICS)]), np.concatenate([value, z / 2])

    def score(self, at: np.ndarray, value: np.ndarray) -> float:
        parts = self.vectors[at] * value[:, None]
        pairs = 0.5 * float((parts.sum(axis=0) ** 2 - (parts**2).sum(axis=0)).sum())
        z = self.bias + float(self.weight[at] @ value) + pairs
        return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def _inputs(rows: DataFrame, metadata: tuple[str, ...]) -> DataFrame:
    """``text`` and ``extra``: the named metadata as ``name=value`` texts."""
    extra = F.array(*[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in metadata])
    return rows.withColumn("__extra", extra.cast("array<string>"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: Column | None = None,
          per_class: int = PER_CLASS, metadata: tuple[str, ...] = ()) -> Machine:
    """Machine from a labelled sample; without labels of both classes it scores
    every document by what share of the sample is labelled 1 (a half if none)."""
    sample = labelled_sample(docs, labels, label, per_class, rows)
    if metadata:
        sample = sample.join(docs.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in metadata]), "doc_id")

    def run(batches):
        for b in batches:
            out = {"doc_id": b["doc_id"], "label": b["label"], "at": [], "value": [], "stats": []}
            for x, extra in zip(b["text"].to_pylist(), b["__extra"].to_pylist()):
                ws = words(x)
                at, value = hashed(ws, extra)
                out["at"].append(at)
                out["value"].append(value)
                out["stats"].append(statistics(x, ws))
            yield out

    found = map_slices(_inputs(sample, metadata).select("doc_id", "label", "text", "__extra"), run,
                       "doc_id long, label int, at array<int>, value array<float>, stats array<double>").toPandas().sort_values("doc_id")
    y = found["label"].to_numpy(float)
    m = Machine(0.0, np.zeros(HASHED + STATISTICS), np.random.default_rng(1).normal(0, 0.02, (HASHED + STATISTICS, RANK)),
                np.zeros(STATISTICS), np.ones(STATISTICS))
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        m.bias, m.vectors = float(np.log((p + 0.01) / (1.01 - p))), m.vectors * 0
        return m
    stats = np.array(found["stats"].tolist())
    m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    cases = [m.features(np.asarray(a, "i4"), np.asarray(v), s) for a, v, s in zip(found["at"], found["value"], stats)]
    _fit(m, cases, y)
    return m


def _fit(m: Machine, cases: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
    """AdaGrad on the logistic loss, both classes with the same total weight."""
    importance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    gw, gv, gb = np.full(len(m.weight), 1e-3), np.full(m.vectors.shape, 1e-3), 1e-3
    rng = np.random.default_rng(2)
    for _ in range(EPOCHS):
        order = rng.permutation(len(cases))
        for i in range(0, len(order), BATCH):
            chosen = order[i:i + BATCH]
            seg = np.repeat(np.arange(len(chosen)), [len(cases[c][0]) for c in chosen])
            at = np.concatenate([cases[c][0] for c in chosen])
            value = np.concatenate([cases[c][1] for c in chosen])
            parts = m.vectors[at] * value[:, None]
            starts = np.flatnonzero(np.diff(seg, prepend=-1))
            total = np.add.reduceat(parts, starts)
            z = (m.bias + np.add.reduceat(m.weight[at] * value, starts)
                 + 0.5 * (total**2 - np.add.reduceat(parts**2, starts)).sum(axis=1))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) * importance[chosen] / len(chosen)
            step = err[seg] * value
            used, place = np.unique(at, return_inverse=True)
            dw = np.bincount(place, step, len(used)) + DECAY * m.weight[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, place, step[:, None] * (total[seg] - parts))
            dv += DECAY * m.vectors[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            m.weight[used] -= RATE * dw / np.sqrt(gw[used])
            m.vectors[used] -= RATE * dv / np.sqrt(gv[used])
            m.bias -= RATE * err.sum() / np.sqrt(gb)


def size_class() -> Column:
    """Metadata of a document: the doublings of its ``n_chars`` (null: none)."""
    return F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(0)) + 1)).cast("int")


def accepted(docs: DataFrame, machine: Machine, metadata: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``docs`` with all their columns, whatever they are called, that the
    machine predicts as 1; ``metadata`` by name, over ``text`` and ``n_chars``."""
    metadata = metadata or {}

    def change(d: DataFrame) -> DataFrame:
        named = d.withColumns(metadata) if metadata else d
        return with_scores(named, machine, tuple(metadata)).filter("__predicted = 1").select(*d.columns)

    return by_position(docs, change, "text", "n_chars")


def with_scores(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ()) -> DataFrame:
    """All rows and columns of ``docs``, and ``__score`` (0 to 1) and
    ``__predicted`` (1 from a half on).

    A null or empty text is scored by its statistics alone.  Repeated rows and
    null ids are scored row by row; columns but those named are never looked
    at; an empty table gives no rows; texts are taken whole."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        m = shared.value

        def run(documents, extras):
            scores = []
            for x, extra in zip(documents, extras):
                ws = words(x)
                scores.append(m.score(*m.features(*hashed(ws, extra), statistics(x, ws))))
            return {"__score": scores, "__predicted": [int(s >= 0.5) for s in scores]}

        return run

    return append_columns(_inputs(docs, metadata), make, "__score double, __predicted int", "__extra").drop("__extra")
