"""Columns of numbers packed to one binary value, so that a shuffle moves few
bytes: the bytes of equal weight stand together and are compressed."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa


def steps(x: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as differences, which are smaller."""
    x = x.view("u8")
    return np.diff(x, prepend=x.dtype.type(0))


def summed(x: np.ndarray) -> np.ndarray:
    """What ``steps`` was made of."""
    return np.cumsum(x, dtype="u8").view("i8")


def _small(x: np.ndarray) -> np.ndarray:
    """Numbers that are not negative, in no more bytes than they need."""
    return x.astype(np.min_scalar_type(int(x.max()))) if x.dtype.kind in "iu" and len(x) and x.min() >= 0 else x


def pack(*columns: np.ndarray) -> bytes:
    planes = []
    for x in columns:
        y = np.ascontiguousarray(_small(x))
        planes.append((x.dtype.str, y.dtype.str, np.ascontiguousarray(y.view("u1").reshape(-1, y.itemsize).T).tobytes()))
    raw = pickle.dumps(planes, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The columns of ``pack``, of the types they had."""
    out = []
    for kind, small, raw in pickle.loads(pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)):
        planes = np.frombuffer(raw, "u1").reshape(np.dtype(small).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(small).reshape(-1).astype(kind, copy=False))
    return out


def grouped(at: np.ndarray, n: int):
    """(group, slice) of each group below ``n`` that is in the sorted ``at``."""
    cuts = np.searchsorted(at, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        yield int(k), slice(int(cuts[k]), int(cuts[k + 1]))


def indexed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, place of each): small where values come again."""
    values, place = np.unique(x, return_inverse=True)
    return values, place
