"""Paths through Hadoop's file system, so any store that Spark reads can be listed."""

from __future__ import annotations

from pyspark.sql import SparkSession


def list_path(spark: SparkSession, path: str) -> list[tuple[str, str, bool, int, int]]:
    """(name, full path, is a folder, modification time, bytes) of the entries of a folder, by name.

    A path that does not exist gives an empty list.
    """
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime(), s.getLen()) for s in fs.listStatus(root)]
    return sorted(found)


def status(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(modification time, bytes) of a file or folder, None if there is none."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    s = fs.getFileStatus(p)
    return s.getModificationTime(), s.getLen()
