"""Exact global ranking without a single-partition sort.

``row_number() over (order by ...)`` with no partition key moves every row into
one task.  Here the rows are range-partitioned on a total order (Spark samples
the bounds, so a heavily repeated value is split by the tie-break columns),
sorted inside each partition and numbered locally; a per-partition count (one
row per partition, so its size is bounded by the partition count we choose)
gives each partition's offset.  The numbered frame is checkpointed before the
counts are taken, so both sides see the same partition assignment even if a
task is re-run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditscope.session import freeze

_LOCAL_BITS = 33  # monotonically_increasing_id: partition index << 33 | row index


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_numbered(df: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by ``order``, with ``_pid`` (range) and ``_at``
    (place in the range); checkpointed, so every reader sees the same ranges."""
    numbered = freeze(df.repartitionByRange(_partitions(df, partitions), *order).sortWithinPartitions(*order)
                      .withColumn("_mid", F.monotonically_increasing_id()))
    return numbered.withColumns({
        "_pid": F.shiftright(F.col("_mid"), _LOCAL_BITS),
        "_at": F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))}).drop("_mid")


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "_rank",
                total_col: str = "_total", partitions: int | None = None) -> DataFrame:
    """Add the exact 1-based position of each row in ``order`` (which must be a
    total order: end it with a unique key) and the row count."""
    numbered = range_numbered(df, order, partitions)
    counts = numbered.groupBy(F.col("_pid").alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy()).alias(total_col))
    # At most one row per range partition: a proven bound, safe to broadcast.
    ranked = numbered.join(F.broadcast(offsets), F.col("_pid") == F.col("_range"))
    return (ranked.withColumn(rank_col, F.col("_offset") + F.col("_at") + F.lit(1))
            .drop("_at", "_pid", "_range", "_offset"))


def _ceil_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - F.lit(1), b)


def ntile_distributed(df: DataFrame, k: int, order: Sequence[Column], out: str,
                      partitions: int | None = None) -> DataFrame:
    """``NTILE(k) OVER (ORDER BY order)``, exact, with the first ``N % k`` tiles
    one row larger, computed without a single-partition window."""
    ranked = global_rank(df, order, partitions=partitions)
    n, rn = F.col("_total"), F.col("_rank")
    q = F.call_function("div", n, F.lit(k).cast("bigint"))
    r = n - q * F.lit(k)
    big = q + F.lit(1)
    tile = (F.when(q == 0, rn)
            .when(rn <= r * big, _ceil_div(rn, big))
            .otherwise(r + _ceil_div(rn - r * big, q)))
    return ranked.withColumn(out, tile.cast("int")).drop("_rank", "_total")


def exact_medians(df: DataFrame, cols: Sequence[str], partitions: int | None = None) -> DataFrame:
    """One row: the exact (interpolated) median of each column, NULLs skipped.

    Values are counted (a map-side combined aggregate), the distinct (column, value)
    pairs are range-partitioned, and running counts inside each range plus the counts
    of the ranges before it place the two middle ranks.  One plan for any number of
    distinct values; a value that a third of the rows share is one counted pair.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v"))
                      for i, c in enumerate(cols)])
    counted = (df.select(F.explode(pairs).alias("_p")).select("_p._col", "_p._v").where("_v is not null")
               .groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_n")))
    numbered = range_numbered(counted, [F.col("_col"), F.col("_v")], partitions)
    # One row per range and column: a proven bound.
    ranges = numbered.groupBy(F.col("_pid").alias("_range"), F.col("_col").alias("_rcol")).agg(
        F.sum("_n").alias("_rn"))
    earlier = Window.partitionBy("_rcol").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", "_rcol", F.coalesce(F.sum("_rn").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_rn").over(Window.partitionBy("_rcol")).alias("_total"))
    running = Window.partitionBy("_pid", "_col").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (numbered.withColumn("_upto", F.sum("_n").over(running))
              .join(F.broadcast(ranges), (F.col("_pid") == F.col("_range")) & (F.col("_col") == F.col("_rcol")))
              .withColumn("_upto", F.col("_upto") + F.col("_before")))
    lo = F.call_function("div", F.col("_total") + F.lit(1), F.lit(2).cast("bigint"))
    hi = F.call_function("div", F.col("_total"), F.lit(2).cast("bigint")) + F.lit(1)

    def value_at(i: int, rank: Column) -> Column:
        inside = (F.col("_col") == i) & (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
        return F.max(F.when(inside, F.col("_v")))

    return placed.agg(*[((value_at(i, lo) + value_at(i, hi)) / F.lit(2.0)).alias(c) for i, c in enumerate(cols)])


def approximate_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Opt-in: bounded memory, but not the interpolated median (9 for 9.5)."""
    return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100_000).alias(c) for c in cols])
