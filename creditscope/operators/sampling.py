"""Seeded exact-size sample, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the histogram's prefixes: at most 65,536 of them.
_PREFIX = 4


def sample_key(id_col: str, seed: int):
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def deterministic_sample(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """The ``n`` rows with the smallest md5(id-seed) (ties by id), in that order:
    min(n, N) rows, the same in any engine and for any partitioning.

    A histogram of hash prefixes gives the prefix that holds the n-th row, as a
    scalar subquery; only rows up to it are ordered.
    """
    key = sample_key(id_col, seed)
    prefix = F.substring(key, 1, _PREFIX)
    histogram = df.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    cut = histogram.select("_p", upto.alias("_upto")).where(F.col("_upto") >= n).agg(F.min("_p")).scalar()
    return df.where(prefix <= F.coalesce(cut, F.lit("g"))).orderBy(key, F.col(id_col)).limit(n)
