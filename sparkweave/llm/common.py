"""Helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave import fs
from sparkweave.session import fresh_path

#: What a Python task turns into objects at a time: rows, and bytes on average.
SLICE_ROWS, SLICE_BYTES = 1024, 4 << 20
#: Entries in each half of a worker's cache (a bound of memory only).
CACHE_ENTRIES = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a documents table, plus ``keep``."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)


#: Folders written since each of the enclosing ``scratch`` blocks began.
_SCRATCH: list[list[str]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends
    there, and a lost executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    for paths in _SCRATCH:
        paths.append(path)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove what ``materialise`` wrote, once nothing reads it any more (all that
    was made of it is written itself)."""
    for t in tables:
        if t is not None:
            fs.delete(t.sparkSession, t.written_at)


@contextlib.contextmanager
def scratch(spark: SparkSession, kept: list[DataFrame]) -> Iterator[None]:
    """Removes at its end, unless that is an error, all that ``materialise`` wrote
    in it but the tables in ``kept`` (which may be added to inside)."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
    stays = {t.written_at for t in kept}
    for path in paths:
        if path not in stays:
            fs.delete(spark, path)


def positioned(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with names of ours for all columns but its ``own``."""
    return docs.toDF(*[c if c in own else f"other_{i}" for i, c in enumerate(docs.columns)])


def by_position(docs: DataFrame, change: Callable[[DataFrame], DataFrame], *own: str) -> DataFrame:
    """``change`` applied to ``docs`` while all columns but its ``own`` have names of
    ours, so that no name clashes with a work column, is ambiguous or holds a
    dot.  ``change`` keeps the columns and their order."""
    return change(positioned(docs, *own)).toDF(*docs.columns)


def fold(doc_id: Column | str, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % k


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_ROWS, nbytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut to at most ``most`` rows and about ``nbytes``."""
    for batch in batches:
        rows = max(1, min(most, batch.num_rows * nbytes // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_schema(spark_schema: str) -> pa.Schema:
    """Arrow schema of a flat DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(spark_schema))


#: What this worker keeps from task to task: one operator's encoder and its caches.
_HELD: dict[str, Any] = {}


def held(name: str, make: Callable[[], Any]) -> Any:
    """The worker's object of that name, made if it isn't there; others go."""
    release(name)
    if name not in _HELD:
        _HELD[name] = make()
    return _HELD[name]


def release(but: str | None = None) -> None:
    """Let go of what other operators' tasks have left in this worker."""
    others = [x for x in _HELD if x != but]
    for name in others:
        del _HELD[name]
    if others:
        gc.collect()  # an encoder and its caches refer to each other


@contextlib.contextmanager
def task(holds: str | None) -> Iterator[None]:
    """A task that uses the held object of that name, if any.  Python's search
    for reference cycles is off in it: these tasks make none, and their caches
    are long to search."""
    release(holds)
    gc.disable()
    try:
        yield
    finally:
        gc.enable()
        pa.default_memory_pool().release_unused()


def gathered(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Record batches put together to at least ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def map_slices(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str, rows: int | None = None,
               holds: str | None = None, cut: tuple[int, int] = (SLICE_ROWS, SLICE_BYTES)) -> DataFrame:
    """``mapInArrow`` for a generator that takes slices of at most ``cut`` rows and
    bytes (or tables of about ``rows`` rows of numbers) and yields column dicts;
    ``holds`` names what its workers keep from task to task."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(holds):
            for columns in fn(gathered(batches, rows) if rows else slices(batches, *cut)):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict]:
    """Column lists of each run of rows with the same keys (sorted input)."""
    names, rows, last = None, [], None
    for b in batches:
        names = b.schema.names
        at = [names.index(k) for k in keys]
        for row in zip(*[b[c].to_pylist() for c in names]):
            key = tuple(row[i] for i in at)
            if rows and key != last:
                yield dict(zip(names, zip(*rows)))
                rows = []
            rows.append(row)
            last = key
    if rows:
        yield dict(zip(names, zip(*rows)))


def append_columns(df: DataFrame, make: Callable[[], Callable[..., dict]], schema: str, *more: str) -> DataFrame:
    """``df`` with columns made from its ``text`` (null: empty) and the columns
    ``more``; ``make`` is called once a task and gives the function for lists."""
    new, out = arrow_schema(schema), T.StructType(df.schema.fields + T._parse_datatype_string(schema).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task(None):
            fn = make()
            for b in slices(batches):
                columns = fn([x or "" for x in b["text"].to_pylist()], *[b[c].to_pylist() for c in more])
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(columns[f.name], f.type) for f in new]],
                                                 names=[*b.schema.names, *new.names])

    return df.mapInArrow(run, out)


class Cache:
    """What a worker remembers of strings.  When it is full, its entries become
    the older half, from which those still in use are taken back."""

    def __init__(self, make: Callable[[list[str]], Iterable], limit: int = CACHE_ENTRIES, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.younger: dict = {}
        self.older: dict = {}

    def lookup(self, keys: list[str]) -> list:
        """Values of ``keys``; those that are missing are made together."""
        found = list(map(self.younger.get, keys))
        missing = {k for k, v in zip(keys, found) if v is None}
        if not missing:
            return found
        here = {k: v for k in missing if (v := self.older.get(k)) is not None}
        new = [k for k in missing if k not in here]
        here.update(zip(new, self.make(new)))
        if len(self.younger) + len(here) > self.limit:
            self.older, self.younger = self.younger, {}
        self.younger.update((k, v) for k, v in here.items() if len(k) <= self.longest)
        return [here[k] if v is None else v for k, v in zip(keys, found)]


def joined(parts: list[list[str]], values: list[bytes]) -> list[bytes]:
    """The values of each list's strings, put together."""
    out, at = [], 0
    for p in parts:
        out.append(b"".join(values[at:at + len(p)]))
        at += len(p)
    return out


def words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, A-Z in lower case (other
    characters as they are): what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    """64-bit identity of a word."""
    return xxhash.xxh3_64_intdigest(word)
