"""Dataset, storage and topic statistics (AGG-1..6, SRT-1, STR-2, PRJ-10).

All statistics are plain aggregations: Spark computes partial aggregates in
each task before the shuffle, so a hot key costs one row per task, not one
task for the key.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MB = 1024 ** 2


def profile(df: DataFrame) -> DataFrame:
    """Row count, column count and column list (one row)."""
    cols = df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(cols)).cast("int").alias("n_cols"), F.lit(", ".join(cols)).alias("cols"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of each non-NULL value, most frequent first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column)
              .agg(F.count(F.lit(1)).alias("count"))
              .orderBy(F.desc("count"), F.col(column)))


def format_size(nbytes: Column, unit: int = MB, suffix: str = "MB") -> Column:
    """``'%.2f MB'`` of ``nbytes / unit``; rounded half-even first so the
    text matches Python's formatting of the same double."""
    return F.format_string(f"%.2f {suffix}", F.bround(nbytes.cast("double") / F.lit(float(unit)), 2))


def size_summary(df: DataFrame, size_col: str, group_cols: list[str] | None = None) -> DataFrame:
    """Objects and total size (bytes and formatted), optionally per group."""
    aggs = [F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum(size_col), F.lit(0)).cast("bigint").alias("total_bytes")]
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(*aggs).withColumn("total_size", format_size(F.col("total_bytes")))


def normalize_prefix(prefix: str) -> str:
    """A folder prefix always ends with '/', so 'users' does not match 'users.csv'."""
    return prefix if prefix.endswith("/") else prefix + "/"


def folder_summary(inventory: DataFrame, prefix: str, path_col: str = "path",
                   size_col: str = "length", root: str = "") -> DataFrame:
    """Summary of the objects whose key starts with the folder ``prefix``."""
    p = normalize_prefix(prefix)
    sel = inventory.where(F.col(path_col).startswith(p))
    return size_summary(sel, size_col).select(F.lit(root + p).alias("folder"), "objects", "total_bytes", "total_size")


def topic_stats(log: DataFrame, commits: DataFrame | None = None, topic_col: str = "topic",
                partition_col: str | None = None, offset_col: str = "offset",
                value_col: str = "value") -> DataFrame:
    """Per topic (and partition): size in KB (bytes / 1000), published =
    max offset + 1, consumed = the slowest group's position (last committed
    offset + 1; 0 where no group has read), when ``commits`` (group, topic,
    partition, offset) is given."""
    keys = [topic_col] + ([partition_col] if partition_col else [])
    stats = log.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.octet_length(F.col(value_col))), F.lit(0)) / F.lit(1000.0)).alias("size_kb"),
        (F.max(offset_col) + 1).alias("published"))
    if commits is None:
        return stats
    consumed = (commits.groupBy(*keys, "group").agg((F.max(offset_col) + 1).alias("_o"))
                .groupBy(*keys).agg(F.min("_o").alias("consumed")))
    return stats.join(consumed, keys, "left").withColumn("consumed", F.coalesce("consumed", F.lit(0).cast("bigint")))


def _since(df: DataFrame, ts_col: str, back: _dt.timedelta, now: _dt.datetime | None) -> DataFrame:
    """Rows of the last ``back`` before ``now`` (wall clock of the session's
    zone) or before the newest row.  The newest timestamp is a scalar subquery:
    it never becomes a Python value, so the driver's zone does not matter."""
    span = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(back.total_seconds()))
    dtype = df.schema[ts_col].dataType
    newest = F.lit(now.isoformat(sep=" ")).cast(dtype) if now is not None else df.agg(F.max(ts_col)).scalar()
    bound = newest - span
    return df.where((F.col(ts_col) >= bound) | newest.isNull())


def retention(df: DataFrame, ts_col: str, seconds: int = 86_400, now: _dt.datetime | None = None) -> DataFrame:
    """Rows not older than ``seconds`` before ``now`` (default: newest row).

    All rows stay if no row has a timestamp.
    """
    return _since(df, ts_col, _dt.timedelta(seconds=seconds), now)


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def parse_relative(start: str) -> _dt.timedelta:
    """'15m-ago', '1h-ago', '1d-ago' ... -> timedelta."""
    m = re.fullmatch(r"(\d+)([smhdw])-ago", start.strip())
    if not m:
        raise ValueError(f"bad relative start {start!r}; expected like '15m-ago'")
    return _dt.timedelta(seconds=int(m.group(1)) * _UNITS[m.group(2)])


_AGGS = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}


def downsample(df: DataFrame, ts_col: str, value_col: str, every: str = "15 minutes",
               aggregator: str | dict[str, str] = "avg", start: str | None = None,
               now: _dt.datetime | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """Metric query: keep points since ``start`` ('1d-ago' ... relative to
    ``now``, default the newest point), then aggregate per time bucket.

    ``aggregator`` is one of avg/sum/min/max/count/none, or a dict
    ``{output_name: aggregator}``.  ``none`` returns the raw points.
    """
    group_cols = group_cols or []
    if start is not None:
        df = _since(df, ts_col, parse_relative(start), now)
    if aggregator == "none":
        return df.select(F.col(ts_col).alias("bucket"), *group_cols, F.col(value_col).alias("value"))
    spec = {"value": aggregator} if isinstance(aggregator, str) else aggregator
    for name, a in spec.items():
        if a not in _AGGS:
            raise ValueError(f"unknown aggregator {a!r} for {name!r}")
    aggs = [_AGGS[a](F.col(value_col)).alias(name) for name, a in spec.items()]
    return (df.groupBy(F.window(ts_col, every).start.alias("bucket"), *group_cols).agg(*aggs))


def metric_snapshot_columns(response_ms: int | Column | None = None) -> list[Column]:
    """Topic-info rows -> chart rows: ``timestamp`` (epoch ms of the response,
    default the row's own), ``Size (KB)`` = logicalsize / 1000,
    ``Published`` = maxoffset + 1, ``Consumed`` = minoffsetacrossconsumers."""
    ts = (F.lit(response_ms) if isinstance(response_ms, int) else response_ms) if response_ms is not None \
        else F.col("timestamp")
    return [F.timestamp_millis(ts.cast("long")).alias("timestamp"), (F.col("logicalsize") / F.lit(1000.0)).alias("size_kb"),
            (F.col("maxoffset") + 1).alias("published"), F.col("minoffsetacrossconsumers").alias("consumed")]


def metric_snapshot(raw: DataFrame, response_ms: int | Column | None = None) -> DataFrame:
    """The chart rows of a poll (see ``metric_snapshot_columns``)."""
    return raw.select(*metric_snapshot_columns(response_ms))


def epoch_seconds(seconds: Column) -> Column:
    """Epoch seconds -> timestamp (the shape of metric query points)."""
    return F.timestamp_seconds(seconds)
