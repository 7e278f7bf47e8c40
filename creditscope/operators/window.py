"""Per-key window operators.

Hot keys: ``latest_per_key`` and ``keep_first`` filter on ``row_number() == 1``,
which Catalyst turns into a partial ``WindowGroupLimit`` before the shuffle, so
each map task ships at most one row per key whatever the key's size.
``trim_after_event`` is built from a per-key top-2 and a join instead of a
running window, so a hot key is limited map-side and split by AQE's skew join.
``next_value`` (LEAD) works inside range partitions of (key, order), so a key
holding a third of all rows is spread over every range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(cols: Sequence[Column | str], descending: bool) -> list[Column]:
    out = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out.append(c.desc_nulls_last() if descending else c.asc_nulls_last())
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (give a unique tie-break last)."""
    w = Window.partitionBy(*keys).orderBy(*_order(order, descending=True))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def keep_first(df: DataFrame, keys: Sequence[str], position: Column | str) -> DataFrame:
    """Key dedupe where the first row by input ``position`` wins."""
    w = Window.partitionBy(*keys).orderBy(*_order([position], descending=False))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
               value: str, out: str, partitions: int | None = None) -> DataFrame:
    """LEAD: the value on the key's next row by ``order`` (next row, not next period).

    Rows are range-partitioned by (keys, order); each row looks at its successor
    inside its range, and the last row of a range at the first row of the next one.
    A key of any size is spread over ranges, and no plan depends on a count.
    """
    from creditscope.operators.ranking import range_numbered
    sequence = [F.col(k).asc_nulls_last() for k in keys] + _order(order, descending=False)
    numbered = range_numbered(df, sequence, partitions)
    own = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(value).alias("v"))
    inside = Window.partitionBy("_pid").orderBy("_at")
    # One row per range: a proven bound, safe to broadcast and to order in one task.
    firsts = numbered.where("_at = 0").select(F.col("_pid").alias("_range"), own.alias("_first"))
    following = firsts.select("_range", F.lead("_first").over(Window.orderBy("_range")).alias("_following"))
    paired = (numbered.withColumn("_next", F.lead(own).over(inside))
              .join(F.broadcast(following), F.col("_pid") == F.col("_range"), "left")
              .withColumn("_next", F.coalesce("_next", "_following")))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_next.k{i}"))
    found = F.when(F.col("_next").isNotNull() & same, F.col("_next.v"))
    return paired.select(*df.columns, found.alias(out))


def trim_after_event(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column | str,
                     keep_events: int = 1) -> DataFrame:
    """Rows whose running count of ``flag`` (inclusive, in ``order``) is at most
    ``keep_events``: everything strictly before the key's next event.

    Built as: number the flagged rows per key (a top-N that Catalyst limits
    map-side), take the position of event ``keep_events + 1``, and keep rows that
    sort before it.  No all-rows window per key.
    """
    flag_col = F.col(flag) if isinstance(flag, str) else flag
    # NULLs last, as in the window.
    place = [x for c in order for x in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))]
    pos = F.struct(*place)
    w = Window.partitionBy(*keys).orderBy(*_order(order, descending=False))
    cut = (df.filter(flag_col)
           .select(*keys, *order)
           .withColumn("_n", F.row_number().over(w))
           .filter(F.col("_n") == keep_events + 1)
           .select(*[F.col(k).alias(f"_cut_{k}") for k in keys],
                   F.struct(*place).alias("_cut")))
    match = None
    for k in keys:  # null-safe: NULL keys form one group, as in the window
        c = F.col(k).eqNullSafe(F.col(f"_cut_{k}"))
        match = c if match is None else match & c
    joined = df.join(cut, match, "left")
    return joined.filter(F.col("_cut").isNull() | (pos < F.col("_cut"))).select(*df.columns)
