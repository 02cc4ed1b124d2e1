"""Sizes of a whole folder tree from an inventory table (AGG-4, SRC-16).

The roll-up goes bottom-up: objects are counted by their own folder once, and
then each level, deepest first, folds into its parents.  A folder meets its
parent's level as one row, so the rows of a step are folders of one level and
never objects times their depth; no file system is listed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.session import written


def parent_folder(path: Column) -> Column:
    """The folder of a path: all but its last part ('' at the top)."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_depth(folder: Column) -> Column:
    """Number of parts ('' has none)."""
    return F.when(folder == "", 0).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1).cast("int")


def clean_path(path: Column) -> Column:
    """No slash at the start and none twice."""
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/", "")


def folder_tree(inventory: DataFrame, path_col: str = "path", size_col: str = "length", newest_col: str = "modified") -> DataFrame:
    """``folder``, ``depth``, ``objects`` and ``total_bytes`` below it, the ``newest``
    of them, and ``direct_objects`` in the folder itself, for every folder that
    holds anything at any depth; the top is ''.

    A NULL size counts as 0; a NULL path is in no folder; a path that ends with
    a slash is an object of the folder it names.  An empty inventory gives no
    rows.  Every level is a job of its own, so there are as many as parts in the
    deepest path."""
    folder = parent_folder(clean_path(F.col(path_col)))
    direct = written(
        inventory.where(F.col(path_col).isNotNull()).select(folder.alias("folder"), F.col(size_col).alias("n"), F.col(newest_col).alias("at"))
        .groupBy("folder").agg(F.count("*").alias("objects"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_bytes"),
                               F.max("at").alias("newest"), F.count("*").alias("direct_objects"))
        .withColumn("depth", folder_depth(F.col("folder"))), "folder-sizes")
    deepest = direct.agg(F.max("depth")).first()[0]
    if deepest is None:
        return direct.select("folder", "depth", "objects", "total_bytes", "newest", "direct_objects")
    levels: list[DataFrame] = []
    for depth in range(deepest, -1, -1):
        rows = direct.where(F.col("depth") == depth)
        if levels:
            up = levels[-1].select(parent_folder(F.col("folder")).alias("folder"), "objects", "total_bytes", "newest",
                                   F.lit(0).cast("long").alias("direct_objects"), F.lit(depth).alias("depth"))
            rows = rows.unionByName(up)
        levels.append(written(
            rows.groupBy("folder").agg(F.sum("objects").alias("objects"), F.sum("total_bytes").alias("total_bytes"), F.max("newest").alias("newest"),
                                       F.sum("direct_objects").alias("direct_objects"))
            .withColumn("depth", F.lit(depth)), "folder-levels"))
    return reduce(DataFrame.unionByName, levels).select("folder", "depth", "objects", "total_bytes", "newest", "direct_objects")
