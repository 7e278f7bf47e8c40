"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters the records into memory-sized buckets by a seeded hash.  Pass 2
Fisher-Yates shuffles each bucket (``shuffle`` is Spark's in-memory Fisher-Yates)
and writes it.  A record's place in the whole order is its bucket's offset plus
its place in the bucket; places are dealt round-robin to the shards, so row
counts of shards differ by one at most and slots have no gaps.

Defined cases: null or empty texts count one byte; a null id is a value like any
other; repeated rows are all kept, each with a slot of its own; an empty table
gives no rows; input columns stay inside ``record`` and cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.llm.tables import stored, tasks_for

BUCKET_BYTES = 16 << 20
SEED = 20240229
#: Up to so many bucket offsets (16 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_BUCKETS = 1_000_000


#: Rows with equal id and text that may lie in one bucket.
EQUAL_ROWS = 1024


def record_bytes(text: str = "text") -> F.Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def external_shuffle(records: DataFrame, id_col: str = "doc_id", text: str = "text",
                     n_shards: int = 16, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Columns ``record`` (the input row), ``shard`` and ``slot``.

    The bucket count follows from the data volume, so a bucket stays at about
    ``bucket_bytes`` whatever the size of the table: of rows with equal id and text,
    more than ``EQUAL_ROWS`` are spread over several buckets.  A bucket is a partition of
    its own and sorted before it is shuffled, so its order follows from the seed and its rows, however the input
    is partitioned (but where such copies fall).  The shuffled buckets are a
    written table: the order is drawn once and holds for every later reader.
    """
    total = records.select(F.sum(record_bytes(text)).alias("b")).first()["b"] or 0
    buckets = tasks_for(total, bucket_bytes)
    own, said = F.col(f"`{id_col}`"), F.crc32(F.encode(F.col(f"`{text}`"), "utf-8"))
    row = records.select(F.xxhash64(F.lit(seed), own, said).alias("key"), F.monotonically_increasing_id().alias("place"),
                         F.xxhash64(F.lit(seed + 1), own).alias("draw"),
                         F.struct(*[F.col(f"`{c}`").alias(c) for c in records.columns]).alias("record"))
    many = stored(row.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > EQUAL_ROWS), "copied")
    many = many.withColumnRenamed("key", "of")
    if many.count() <= BROADCAST_BUCKETS:
        many = F.broadcast(many)  # the records then move only once
    # A copy's salt comes from its place at the scan, which a retry gives again.
    salt = F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64("place"), F.call_function(
        "div", F.col("copies"), F.lit(EQUAL_ROWS).cast("long")) + 1)).otherwise(F.lit(0))
    scattered = row.join(many, F.col("key") == F.col("of"), "left").select(
        F.pmod(F.xxhash64("key", salt), F.lit(buckets)).cast("int").alias("bucket"), "draw", "record")
    shuffled = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.array_sort(F.collect_list(F.struct("draw", "record"))).alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("at", "row"))
        .select("bucket", "at", F.col("row.record").alias("record")))
    table = stored(shuffled, "shuffled")
    sizes = table.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row per bucket, so this window sees counts, never records.
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("bucket").alias("b"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    placed = table.join(offsets, F.col("bucket") == F.col("b"))
    place = F.col("offset") + F.col("at")
    return placed.select("record",
                         F.pmod(place, F.lit(n_shards)).cast("int").alias("shard"),
                         F.floor(place / n_shards).cast("long").alias("slot"))


def write_shards(shuffled: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file."""
    (shuffled.select("shard", "slot", "record.*") if not {"shard", "slot"} & set(
        shuffled.schema["record"].dataType.fieldNames()) else shuffled)\
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")\
        .write.partitionBy("shard").parquet(path)
