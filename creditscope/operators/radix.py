"""Exact medians by radix selection: no sort, no shuffle of distinct values.

A double becomes a 64-bit key of the same order.  The first pass counts the keys' high
bits; each further pass counts the next bits of the rows inside the chosen bin alone,
until the whole key of each middle rank is known.  A pass shuffles at most one counted
row per bin, column and map task, however many distinct values there are, and the chosen
bins (at most two per column) are a bounded broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits fixed by each pass: sign and exponent, then the mantissa in four parts.
DIGITS = (12, 13, 13, 13, 13)
_FRACTION = 52
_BIAS = 1023


def with_order_key(df: DataFrame, value: str, key: str) -> DataFrame:
    """Adds ``key``: a long for the double ``value``.  Keys compare as the values do, NaN
    above all numbers and -0.0 as 0.0; NULL stays NULL.  Exact, from the value's exponent
    and fraction, in steps so that no part is computed twice."""
    two, least = F.lit(2.0), 1 - _BIAS
    infinite = F.lit((2 * _BIAS + 1) << _FRACTION)
    v, size, e, unit = F.col(value), F.col("_size"), F.col("_exp"), F.col("_unit")
    steps = df.withColumn("_size", F.abs(v.cast("double")))
    steps = steps.withColumn("_exp", F.when((size > 0) & (size < float("inf")),
                                            F.greatest(F.floor(F.log2(size)).cast("int"), F.lit(least))))
    # The logarithm may round across a power of two: step back or forth.
    steps = steps.withColumn("_unit", size / F.pow(two, e))
    steps = steps.withColumn("_exp", F.when(unit >= 2.0, e + 1).when((unit < 1.0) & (e > least), e - 1).otherwise(e))
    steps = steps.withColumn("_unit", size / F.pow(two, e))
    # A subnormal has no leading one: its fraction counts from exponent field 0.
    lead = F.when(unit >= 1.0, 1).otherwise(0)
    bits = F.shiftleft((e + _BIAS - 1 + lead).cast("long"), _FRACTION) + (
        (unit - lead) * F.lit(float(1 << _FRACTION))).cast("long")
    steps = steps.withColumn("_bits", F.when(e.isNotNull(), bits).when(F.isnan(size), infinite + 1)
                             .when(size > 0, infinite).when(size == 0, F.lit(0).cast("long")))
    signed = F.when((v < 0) & ~F.isnan(size), -F.col("_bits")).otherwise(F.col("_bits"))
    return steps.withColumn(key, signed).drop("_size", "_exp", "_unit", "_bits")


def key_value(key: Column) -> Column:
    """The double of a key of ``with_order_key``."""
    size = F.abs(key)
    field = F.shiftright(size, _FRACTION).cast("int")
    fraction = size.bitwiseAND(F.lit((1 << _FRACTION) - 1)).cast("double") / F.lit(float(1 << _FRACTION))
    number = F.when(field > 0, (fraction + 1.0) * F.pow(F.lit(2.0), field - _BIAS)).otherwise(
        fraction * F.pow(F.lit(2.0), F.lit(1 - _BIAS)))
    top = 2 * _BIAS + 1
    number = F.when(field == top, F.when(fraction > 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(number)
    return F.when(key < 0, -number).otherwise(number)


def radix_medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the exact (interpolated) median of each column, NULLs skipped; NULL for a
    column without values.  Equal to ``percentile(col, 0.5)``.

    Lazy, and without a checkpoint: five passes over ``df``, each behind the one before."""
    cells = F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    values = df.select(F.explode(cells).alias("_c")).select("_c._col", "_c._v").where("_v is not null")
    # Never NULL here, and declared so: a filter for NULL keys, pushed below the steps of the
    # key, would spell them out many times over.
    keys = with_order_key(values, "_v", "_key").select("_col", F.coalesce("_key", F.lit(0).cast("long")).alias("_key"))
    bins = Window.partitionBy("_col", "_bin").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
    chosen, left = None, 64
    for width in DIGITS:
        above, left = left, left - width
        digit = F.shiftright("_key", left)
        if chosen is None:
            inside = keys.select("_col", F.lit(0).cast("long").alias("_bin"), digit.alias("_digit"))
        else:
            # At most two bins per column: a proven bound.
            inside = keys.join(F.broadcast(chosen.select(F.col("_col").alias("_of"), "_bin", "_ranks")),
                               (F.col("_col") == F.col("_of")) & (F.shiftright("_key", above) == F.col("_bin"))
                               ).select("_col", "_bin", digit.alias("_digit"), "_ranks")
        more = [] if chosen is None else [F.first("_ranks").alias("_ranks")]
        counted = inside.groupBy("_col", "_bin", "_digit").agg(F.count(F.lit(1)).alias("_n"), *more)
        if chosen is None:
            total = F.sum("_n").over(Window.partitionBy("_col"))
            two = F.lit(2).cast("long")
            counted = counted.withColumn("_ranks", F.array_distinct(F.array(
                F.call_function("div", total + 1, two), F.call_function("div", total, two) + 1)))
        # Ranks within the digit's rows; a window over one row per digit of a chosen bin.
        before = counted.withColumn("_before", F.sum("_n").over(bins) - F.col("_n"))
        held = before.select("_col", F.col("_digit").alias("_bin"), F.transform(
            F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_before") + F.col("_n"))),
            lambda r: r - F.col("_before")).alias("_ranks")).where(F.size("_ranks") > 0)
        chosen = held
    # One key holds both middle ranks, or two keys hold one each.
    ends = chosen.groupBy().agg(*[x for i in range(len(cols)) for x in (
        F.min(F.when(F.col("_col") == i, F.col("_bin"))).alias(f"_lo{i}"),
        F.max(F.when(F.col("_col") == i, F.col("_bin"))).alias(f"_hi{i}"))])
    return ends.select(*[((key_value(F.col(f"_lo{i}")) + key_value(F.col(f"_hi{i}"))) / 2.0).alias(c)
                         for i, c in enumerate(cols)])
