"""Small Hadoop FileSystem helpers (listing, existence, tiny marker files).

They go through the JVM's Hadoop FileSystem so the same code works on
file://, hdfs:// and s3a:// paths.  Only metadata and marker files of a few
bytes pass through the driver; data always moves through Spark readers and
writers.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jpath.getFileSystem(conf), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as readers show it."""
    fs, p = _fs_and_path(spark, path)
    return fs.makeQualified(p).toString()


def list_names(spark: SparkSession, path: str, dirs_only: bool = False) -> list[str]:
    """Names of the direct children of ``path`` (empty if it does not exist)."""
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        if dirs_only and not st.isDirectory():
            continue
        out.append(st.getPath().getName())
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Create a small text file; returns False if it exists and not ``overwrite``.

    The text is written to a file of its own first and renamed, so a reader
    never sees half of it.  Where renaming is atomic (HDFS, local disks) the
    first writer wins; an object store needs a table format with a catalog.
    """
    fs, p = _fs_and_path(spark, path)
    if fs.exists(p) and not overwrite:
        return False
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f"_{p.getName()}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE if overwrite else kind.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(p), options)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs_and_path(spark, path)
    if not fs.exists(p):
        return None
    jvm = spark.sparkContext._jvm
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        while True:
            line = reader.readLine()
            if line is None:
                break
            lines.append(line)
        return "\n".join(lines)
    finally:
        stream.close()


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs_and_path(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or folder; False if there is none."""
    fs, p = _fs_and_path(spark, path)
    return bool(fs.delete(p, True))
