"""Intermediate tables in the shared checkpoint folder, and small frame helpers."""

from __future__ import annotations

import atexit
import io
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from creditscope.session import ensure_checkpoint_dir

_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and return the written table, with
    the values of a column ``by`` in folders of their own.

    Cuts the lineage: later readers survive lost executors and see one fixed
    result.  The files are removed when the driver's Python exits.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started: a zip
    of it in the shared checkpoint folder, added to the session once."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[1]
    if not root.is_dir() or getattr(context, "_shipped_package", None) == str(root):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(root.rglob("*.py")):
            archive.writestr(f"{root.name}/{source.relative_to(root)}", source.read_text())
    path = f"{ensure_checkpoint_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    context._shipped_package = str(root)


def shipped(fn: Callable) -> Callable:
    """A query or stage (its first argument is the session) whose tasks import the package."""
    @wraps(fn)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return fn(spark, *args)
    return run


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is None:
            continue
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


atexit.register(_remove_written)


def tasks_for(units: int, per_task: int) -> int:
    """Number of tasks so that each holds about ``per_task`` units (no upper bound)."""
    return max(1, -(-int(units) // per_task))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
