"""As-of join: the latest known value at or before each row (AGG-5, STR-4).

Both sides are put under each other, sorted by time, and the last value is
carried on.  Time is cut into buckets, so a key is as many groups as it has
buckets and none is one task: inside a bucket the value is carried from row to
row, and what a bucket starts with is carried from bucket to bucket over one
row for each.  There is no range join and no pair of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_AT, _KIND, _VALUE, _ROW = "_at", "_kind", "_value", "_row"


def time_bucket(at: Column, every: str) -> Column:
    """Start of the time bucket."""
    return F.window(at, every).getField("start")


def asof_join(rows: DataFrame, facts: DataFrame, keys: list[str], at: str, fact_at: str, values: list[str], every: str = "1 day") -> DataFrame:
    """``rows`` with the ``values`` of the latest of ``facts`` with the same keys
    whose ``fact_at`` isn't after ``at``; NULL where there is none.

    Of facts of one key and time the greatest values win, column by column.
    Keys match where both are NULL; a row without a time finds nothing, a fact
    without one is not found.  Rows keep their number, repeated ones too."""
    value = F.struct(*values)
    facts = (facts.where(F.col(fact_at).isNotNull()).groupBy(*keys, F.col(fact_at).alias(_AT)).agg(F.max(value).alias(_VALUE))
             .withColumn(_KIND, F.lit(0)))
    asked = rows.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias(_AT), F.struct(*rows.columns).alias(_ROW)).withColumn(_KIND, F.lit(1))
    both = facts.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", time_bucket(F.col(_AT), every))

    # The value that each bucket starts with: of the last bucket before it that has a fact.
    ends = (facts.withColumn("_bucket", time_bucket(F.col(_AT), every))
            .groupBy(*keys, "_bucket").agg(F.max_by(_VALUE, _AT).alias("_end")))
    all_buckets = both.where(F.col("_bucket").isNotNull()).select(*keys, "_bucket").distinct()
    named = lambda df, mark: [F.col(k).alias(f"{mark}{i}") for i, k in enumerate([*keys, "_bucket"])]
    left, right = all_buckets.select(*named(all_buckets, "_l")), ends.select(*named(ends, "_r"), "_end")
    same = None
    for i in range(len(keys) + 1):
        c = F.col(f"_l{i}").eqNullSafe(F.col(f"_r{i}"))
        same = c if same is None else same & c
    by_bucket = left.join(right, same, "left")
    earlier = Window.partitionBy(*[f"_l{i}" for i in range(len(keys))]).orderBy(f"_l{len(keys)}").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_bucket.withColumn("_start", F.last("_end", ignorenulls=True).over(earlier)).drop("_end", *[f"_r{i}" for i in range(len(keys) + 1)])

    inside = Window.partitionBy(*keys, "_bucket").orderBy(_AT, _KIND).rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_last", F.last(_VALUE, ignorenulls=True).over(inside)).where(F.col(_KIND) == 1)
    match = None
    for i, k in enumerate([*keys, "_bucket"]):
        c = F.col(k).eqNullSafe(F.col(f"_l{i}"))
        match = c if match is None else match & c
    joined = carried.join(starts, match, "left")
    found = F.coalesce("_last", "_start")
    timed = joined.select(*[F.col(_ROW).getField(c).alias(c) for c in rows.columns], *[found.getField(v).alias(v) for v in values])
    kinds = [F.lit(None).cast(timed.schema[v].dataType).alias(v) for v in values]
    return timed.unionByName(rows.where(F.col(at).isNull()).select("*", *kinds))


def lag_series(polls: DataFrame, log: DataFrame, commits: DataFrame, topic: str = "topic", at: str = "at", offset: str = "offset",
               every: str = "1 day") -> DataFrame:
    """Per poll (topic, at): ``published`` (offset after the last message by then),
    ``consumed`` (position committed by then) and ``lag``; 0 before the first."""
    positions = log.select(topic, F.col(at).alias("_t"), (F.col(offset) + 1).alias("published"))
    committed = commits.select(topic, F.col(at).alias("_t"), F.col(offset).alias("consumed"))
    rows = asof_join(polls.select(topic, at), positions, [topic], at, "_t", ["published"], every)
    rows = asof_join(rows, committed, [topic], at, "_t", ["consumed"], every)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select(topic, at, zero("published").alias("published"), zero("consumed").alias("consumed"),
                       (zero("published") - zero("consumed")).alias("lag"))
