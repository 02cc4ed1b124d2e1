"""Object inventory (SRC-15, SRC-16, SRC-17).

An inventory is any table ``(path, length, modified)``, such as the inventory
report of an object store; the operators here and in ``operators.tree`` work on
it.  ``read_inventory`` makes one from Spark's own listing of a folder: the
``binaryFile`` source without its contents, which lists wide trees in parallel.
It leaves out hidden and empty files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave import fs


def read_inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path`` (below the root), ``length`` and ``modified`` of the files of a
    folder, and of those below it if ``recursive``."""
    if not fs.exists(spark, root):
        raise FileNotFoundError(f"no such folder: {root}")
    top = fs.qualified(spark, root).rstrip("/") + "/"
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
             .select("path", "length", F.col("modificationTime").alias("modified")))
    return files.withColumn("path", F.substring("path", len(top) + 1, 1 << 30))


def listing(inventory: DataFrame, folder: str = "", allowed: list[str] | None = None) -> DataFrame:
    """One folder level, ``ls``-like: name, size, mtime as 'MMM dd HH:mm'.
    With ``allowed``, a folder outside those roots is refused.
    Sub-folders appear once with the total size of the files below them."""
    if allowed is not None and not any(f"{folder.strip('/')}/".startswith(f"{a.strip('/')}/") for a in allowed):
        raise PermissionError(f"folder {folder!r} is not in the allow-list")
    prefix = folder.rstrip("/") + "/" if folder else ""
    rel = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    sel = inventory.where(F.col("path").startswith(prefix)) if prefix else inventory
    name = F.regexp_extract(rel, r"^([^/]+)", 1)
    return (sel.groupBy(name.alias("name"))
               .agg(F.sum("length").alias("size"), F.max("modified").alias("modified"),
                    (F.max(F.instr(rel, "/")) > 0).alias("is_dir"))
               .withColumn("mtime", F.date_format("modified", "MMM dd HH:mm")))


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables of a catalog database as a DataFrame (name, database, type)."""
    rows = [(t.name, t.database, t.tableType) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, database string, type string")
