"""Stored cube of the portfolio (I-4, A-8): any dashboard filter without the accounts.

The cube holds re-aggregatable sums (never rounded values) for every subset of tier,
product, region and utilization band.  Accounts are aggregated once, to the finest
cells, with a map-side combine; the other subsets come from those few cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditscope.plans.kpis import portfolio_columns, portfolio_sums
from creditscope.plans.root_cause import utilization_band

DIMENSIONS = ("risk_tier", "product_id", "region_id", "utilization_band")
#: Which dimensions a row sums over: bit 8 for the tier down to 1 for the band, as ``grouping_id``.
LEVEL = "grouping_level"
_SUMS = ("accounts", "_bal", "_us", "_un", "_lim", "_d30", "_d60", "_d90", "_co", "_cobal")


def _merged() -> list:
    return [F.sum(c).alias(c) for c in _SUMS]


def portfolio_cube(cur: DataFrame) -> DataFrame:
    """One row of sums per cell of every subset of the dimensions."""
    banded = cur.withColumn("utilization_band", utilization_band())
    cells = banded.groupBy(*DIMENSIONS).agg(*portfolio_sums())
    return cells.cube(*DIMENSIONS).agg(F.grouping_id().cast("int").alias(LEVEL), *_merged()).select(
        LEVEL, *DIMENSIONS, *_SUMS)


def cube_kpis(cube: DataFrame) -> DataFrame:
    """The cube with the headline KPIs of each cell in place of its sums."""
    return cube.select(LEVEL, *DIMENSIONS, *[c.alias(n) for n, c in portfolio_columns()])


def write_cube(cube: DataFrame, path: str) -> None:
    """Stores the cube by level, so that a question reads the files of one level."""
    cube.repartition(LEVEL).write.mode("overwrite").partitionBy(LEVEL).parquet(path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def level_of(kept: Sequence[str]) -> int:
    """The level that keeps these dimensions and sums over the others."""
    return sum(1 << (len(DIMENSIONS) - 1 - i) for i, d in enumerate(DIMENSIONS) if d not in kept)


def cube_slice(cube: DataFrame, by: Sequence[str] = (), where: Mapping[str, object | Sequence] | None = None) -> DataFrame:
    """Headline KPIs sliced by some dimensions under a filter: ``where`` maps a dimension
    to a value or a list of values (None is the NULL cell).  Equal to
    ``portfolio_kpis(filtered accounts, by)`` but read from one level of the cube."""
    where = dict(where or {})
    unknown = sorted((set(by) | set(where)) - set(DIMENSIONS))
    if unknown:
        raise ValueError(f"no dimension {', '.join(unknown)}")
    rows = cube.where(F.col(LEVEL) == level_of({*by, *where}))
    for name, wanted in where.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        rows = rows.where(F.coalesce(F.col(name).isin([v for v in values if v is not None]), F.lit(False))
                          | (F.col(name).isNull() if None in values else F.lit(False)))
    merged = rows.groupBy(*by).agg(*_merged())
    # Without keys an empty book still is one row of zero accounts.
    merged = merged.withColumn("accounts", F.coalesce(F.col("accounts"), F.lit(0)))
    return merged.select(*by, *[c.alias(n) for n, c in portfolio_columns()])
