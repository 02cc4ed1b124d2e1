"""Dense id / offset allocation without a single-task window (SNK-8).

``row_number() over (order by k)`` sends every row through one task.  Here
each input partition numbers its own rows, a tiny per-(group, partition)
count table gives each partition its starting number, and the rows are
numbered ``start + rows in earlier partitions + position``.  Work per task is
bounded by the input partition size, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.session import shared_root


def allocate_ids(df: DataFrame, id_col: str = "id", start: int = 1,
                 group_cols: list[str] | None = None, starts: DataFrame | None = None,
                 order_by: list[str] | None = None, freeze: bool = True) -> DataFrame:
    """Number the rows ``start, start+1, ...`` (per group if ``group_cols``).

    * ``order_by``: ids follow this order (a range-partitioned sort);
      otherwise they follow the input order.
    * ``starts``: optional frame ``group_cols + [_start]`` with the first id
      of each group (e.g. the next free offset of each topic partition);
      groups absent from it start at ``start``.
    * ``freeze``: reliable ``checkpoint()`` of the numbered input so that
      the counting pass and the numbering pass see identical partitions even
      if an executor is lost in between.
    """
    group_cols = list(group_cols or [])
    if order_by:
        # A unique tie-break lets the range partitioner split a value shared
        # by many rows over several tasks instead of one.
        staged = df.withColumn("_tb", F.monotonically_increasing_id()).orderBy(*order_by, "_tb").drop("_tb")
    else:
        staged = df
    staged = staged.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    if group_cols:
        # Rows of one (partition, group) become contiguous; positions are recomputed after the sort.
        staged = (staged.sortWithinPartitions(*group_cols, "_pos")
                  .withColumn("_pos", F.monotonically_increasing_id()))
    if freeze:
        shared_root(df.sparkSession)  # checkpoint dir from spark.checkpoint.dir
        staged = staged.checkpoint(eager=True)

    counts = staged.groupBy(*group_cols, "_pid").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # The count table has one row per (group, input partition); a window over
    # it is small even without group columns.
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if starts is not None and group_cols:
        counts = counts.join(starts, group_cols, "left")
        counts = counts.withColumn("_start", F.coalesce(F.col("_start"), F.lit(start)))
    else:
        counts = counts.withColumn("_start", F.lit(start))
    # Renamed keys: the count table derives from ``staged`` and must not
    # share attribute ids with it in the join condition.
    keys = [*group_cols, "_pid"]
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           "_first", (F.col("_start") + F.col("_base")).alias("_b"))
    # Small (one row per group and input partition): keep it so the size
    # check and the join do not compute it twice.
    counts = counts.persist()
    cond = [staged[k].eqNullSafe(counts[f"_k{i}"]) for i, k in enumerate(keys)]
    out = staged.join(counts, cond, "inner")
    return out.select(*[staged[c] for c in df.columns],
                      (F.col("_b") + F.col("_pos") - F.col("_first")).alias(id_col))
