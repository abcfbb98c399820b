"""Paths on whatever file system the session uses."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or any path a glob stands for, is there."""
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder."""
    fs, p = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p)]


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    _, q = _fs(spark, new)
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {old} to {new}")


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Rename unless the new name is taken: of two writers of a name one gets True, the other False."""
    fs, p = _fs(spark, old)
    _, q = _fs(spark, new)
    jvm, q = spark.sparkContext._jvm, fs.makeQualified(q)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(q.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(p), q, no_options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def found(spark: SparkSession, pattern: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time in ms) of what a glob stands for; metadata only."""
    fs, p = _fs(spark, pattern)
    return [(x.getPath().toUri().getPath(), x.getLen(), x.getModificationTime()) for x in fs.globStatus(p) or []]
