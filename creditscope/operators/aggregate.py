"""Shares of a total over an already-aggregated frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.functions.exprs import rate, share


def share_of_total(grouped: DataFrame, col: str, out: str, digits: int = 1, money: bool = False) -> DataFrame:
    """Add ``out`` = ``col`` as a percentage of its column total.

    The window has no partition key, so it must only ever see a grouped frame
    (a handful of rows), never row-level data.
    """
    total = F.sum(col).over(Window.partitionBy())
    pct = share(F.col(col), total, digits) if money else rate(F.col(col), total, digits)
    return grouped.withColumn(out, pct)
