"""Folders of finished Spark writes, through the Hadoop file system of their path."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, root: str, pattern: str, inner: str = "", parents: int = 0) -> list[str]:
    """Names under ``root`` that match, in order, whose write (in the folder ``inner``) was committed;
    with ``parents`` as much of the path before the name."""
    mark = f"{root}/{pattern}/{inner + '/' if inner else ''}_SUCCESS"
    path, fs = _at(spark, mark)
    names = []
    for status in fs.globStatus(path) or []:
        parts = status.getPath().toString().split("/")[:-2 if inner else -1]
        names.append("/".join(parts[-1 - parents:]))
    return sorted(names)


def remove(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        path, fs = _at(spark, name)
        fs.delete(path, True)
