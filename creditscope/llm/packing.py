"""Packing into optimal length buckets.

A text longer than ``max_len`` tokens is cut into pieces of ``max_len``, so every
token is packed.  One global histogram of piece lengths (at most ``max_len``
values, whatever the table's size) feeds a dynamic programme that chooses
``n_buckets`` upper bounds, multiples of ``align``, with the least total padding.
Inside a bucket, pieces in seeded hash order form batches of
``token_budget // bound`` rows.

Defined cases: a null or empty text has no tokens and gives no piece; equal costs
choose the smaller bounds; repeated rows are pieces of their own; an empty table
gives no rows; input columns besides id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditscope.llm.tables import stored, tasks_for

MAX_LEN = 2048
ALIGN = 16
N_BUCKETS = 8
TOKEN_BUDGET = 16384
ROWS_PER_PART = 200_000
SEED = 11


def word_count(text: str = "text") -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null: none.  One character stands for each
    word: ``regexp_count`` would hold all words of a text as strings."""
    led = F.ltrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    marks = F.regexp_replace(led, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def choose_bounds(histogram: dict[int, int], n_buckets: int = N_BUCKETS, max_len: int = MAX_LEN,
                  align: int = ALIGN) -> list[int]:
    """Bounds with the least padding; the last one holds the longest piece."""
    if not histogram:
        return []
    steps = -(-max(histogram) // align)
    count = np.zeros(steps + 1, dtype=np.int64)
    tokens = np.zeros(steps + 1, dtype=np.int64)
    for length, n in histogram.items():
        count[-(-length // align)] += n
        tokens[-(-length // align)] += n * length
    count, tokens = np.cumsum(count), np.cumsum(tokens)
    bound = np.minimum(np.arange(steps + 1) * align, max_len)
    # cost[i, j]: padding when the lengths above bound i up to bound j share bound j.
    cost = (count[None, :] - count[:, None]) * bound[None, :] - (tokens[None, :] - tokens[:, None])
    cost = np.where(np.arange(steps + 1)[:, None] < np.arange(steps + 1)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, back = cost[0].copy(), [np.zeros(steps + 1, dtype=np.int64)]
    for _ in range(1, min(n_buckets, steps)):
        through = best[:, None] + cost
        through[0] = np.iinfo(np.int64).max // 2
        via = np.argmin(through, axis=0)
        value = np.take_along_axis(through, via[None, :], axis=0)[0]
        back.append(np.where(value < best, via, -1))
        best = np.minimum(best, value)
    at, bounds = steps, []
    for level in range(len(back) - 1, -1, -1):
        if back[level][at] < 0:  # one bucket fewer is as good
            continue
        bounds.append(int(bound[at]))
        at = int(back[level][at])
        if at == 0:
            break
    return bounds[::-1]


def pieces(documents: DataFrame, id_col: str = "doc_id", text: str = "text",
           max_len: int = MAX_LEN) -> DataFrame:
    """Rows (doc_id, piece, length) with 1 <= length <= max_len."""
    counted = documents.select(F.col(id_col).alias("doc_id"), word_count(text).alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / max_len)
    cut = counted.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(max_len).cast("long"),
                                                 F.col("n") - F.col("piece") * max_len).alias("length"))


def pack(documents: DataFrame, id_col: str = "doc_id", text: str = "text", max_len: int = MAX_LEN,
         n_buckets: int = N_BUCKETS, align: int = ALIGN, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Rows (doc_id, piece, length, bucket_len, batch, place): the batch is numbered
    inside its bucket, ``place`` inside the batch."""
    # Written, so that the histogram, the sizes and the rows do not each read the texts.
    cut = stored(pieces(documents, id_col, text, max_len), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bounds = choose_bounds(histogram, n_buckets, max_len, align)
    bucket = F.lit(None).cast("long")
    for b in reversed(bounds):
        bucket = F.when(F.col("length") <= b, F.lit(b).cast("long")).otherwise(bucket)
    # Parts of a bucket: numbered on their own and joined by offsets, so that a
    # bucket of any size is spread over many tasks.
    parts = tasks_for(sum(histogram.values()), ROWS_PER_PART)
    keyed = cut.select("doc_id", "piece", "length", bucket.alias("bucket_len"),
                       F.xxhash64(F.lit(SEED), "doc_id", "piece").alias("draw"))
    keyed = keyed.withColumn("part", F.pmod(F.shiftrightunsigned("draw", 33), F.lit(parts * 16)))
    order = Window.partitionBy("bucket_len", "part").orderBy("draw", "doc_id", "piece")
    numbered = keyed.withColumn("at", F.row_number().over(order) - 1)
    sizes = keyed.groupBy("bucket_len", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_len", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("at")
    rows = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_len"))).cast("long")
    return numbered.join(offsets, ["bucket_len", "part"]).select(
        "doc_id", "piece", "length", "bucket_len",
        F.floor(place / rows).cast("long").alias("batch"), F.pmod(place, rows).cast("long").alias("place"))
