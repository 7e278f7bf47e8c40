"""Names of finished files and folders, through the session's Hadoop file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Gives a file or folder its final name; the name must be free."""
    src, fs = _path(spark, source)
    dst, _ = _path(spark, target)
    if fs.exists(dst):
        raise FileExistsError(target)
    if not fs.rename(src, dst):
        raise OSError(f"could not rename {source} to {target}")


def name_single_part(spark: SparkSession, folder: str, target: str, suffix: str) -> None:
    """Moves the one part file with ``suffix`` out of a written folder to ``target``, in
    place of an older file of that name, and removes the folder."""
    src, fs = _path(spark, folder)
    parts = [s.getPath().toString() for s in fs.listStatus(src) if s.getPath().getName().endswith(suffix)]
    if len(parts) != 1:
        raise ValueError(f"{folder}: {len(parts)} part files")
    dst, _ = _path(spark, target)
    if fs.exists(dst):
        fs.delete(dst, True)
    rename(spark, parts[0], target)
    fs.delete(src, True)
