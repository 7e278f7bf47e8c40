"""Documents in slices, and counts of keys over all slices.

A *text row* is (row, name): ``row`` holds the columns to keep as c0, c1, ..., the
columns a caller adds, and the text; ``name`` says which field is the text, so a text
that is kept travels once.

``key_classes`` counts keys (64-bit hashes) over all slices without one row per key:
a slice sends the keys of each hash shard as one packed row, the shard adds the
counts up, and the slice gets a byte per key back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditscope.llm import textscan
from creditscope.llm.tables import stored

_U = np.uint64
ANSWER = "array<struct<shard:bigint,classes:binary>>"


def text_rows(documents: DataFrame, text: str, keep: list[str] | None, **more: Column) -> tuple[DataFrame, T.StructType]:
    """Text rows, and the type of the kept columns under their own names."""
    kept = documents.columns if keep is None else keep
    inside = text in kept and documents.schema[text].dataType == T.StringType()
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    fields += [column.alias(name) for name, column in more.items()]
    if not inside:
        fields.append(F.col(f"`{text}`").cast("string").alias("text"))
    rows = documents.select(F.struct(*fields).alias("row"),
                            F.lit(f"c{kept.index(text)}" if inside else "text").alias("name"))
    return rows, T.StructType([documents.schema[c] for c in kept])


def field(batch: pa.RecordBatch, name: str) -> pa.Array:
    row = batch.column(0)
    return row.field(row.type.get_field_index(name))


def text_of(batch: pa.RecordBatch) -> pa.Array:
    return field(batch, batch.column(1)[0].as_py())


def own_columns(batch: pa.RecordBatch, kept: T.StructType) -> pa.Array:
    """The kept columns under their own names."""
    row = batch.column(0)
    return pa.StructArray.from_arrays([row.field(i) for i in range(len(kept))], names=kept.fieldNames())


def cut(batches: Iterator[pa.RecordBatch], limit: int = textscan.SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Text rows in pieces of about ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows:
            marked = batch.append_column("_text", text_of(batch))
            for part in textscan.slices(iter([marked]), "_text", limit):
                yield part.select(range(batch.num_columns))
    # Workers are used again by later stages: give back what Arrow keeps for reuse.
    pa.default_memory_pool().release_unused()


def packed(batch: pa.RecordBatch, level: int = 5) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", level))
    with pa.ipc.new_stream(sink, batch.schema, options=options) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(payload: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload.as_buffer()).read_next_batch()


def slices(rows: DataFrame, limit: int = textscan.SLICE_BYTES) -> DataFrame:
    """A written table (slice, n: bytes of text, payload) of text rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(cut(batches, limit)):
            size = len(textscan.raw(text_of(batch))[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + i]), pa.array([size]), pa.array([packed(batch)], pa.binary())],
                names=["slice", "n", "payload"])

    return stored(rows.mapInArrow(run, "slice long, n long, payload binary"), "slices")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the low 24 bits; the high 32 name a key inside its shard."""
    return ((keys & _U(0xFFFFFF)) * _U(shards) >> _U(24)).astype(np.int64)


def distinct_keys(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many owners have each."""
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    if not len(key):
        return key, np.zeros(0, np.int64)
    new = np.append(True, key[1:] != key[:-1])
    other = new | np.append(True, owner[1:] != owner[:-1])
    return key[new], np.add.reduceat(other.astype(np.int64), np.flatnonzero(new))


def key_classes(payloads: DataFrame, keys_of: Callable[[pa.Scalar], tuple[np.ndarray, np.ndarray]],
                shards: int) -> DataFrame:
    """(slice, answers) with the class of every key of every slice: 0 for a key that
    one owner has, else the binary logarithm of its number of owners, rounded up.

    Two keys of a shard with equal high bits count as one, which makes a class too
    high for about one key in ten thousand; callers must bear that."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, owners = keys_of(batch.column(1)[i])
                shard = shard_of(keys, shards)
                owners = np.minimum(owners, 255).astype(np.uint8)
                out = []
                for s in np.unique(shard):
                    mine = np.flatnonzero(shard == s)
                    # The high 32 bits of each key as byte planes, and its owners.
                    planes = (keys[mine] >> _U(32)).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
                    out.append((s, zstandard.compress(planes.tobytes() + owners[mine].tobytes(), 1)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()),
                     pa.array([o[1] for o in out], pa.binary())], names=["shard", "slice", "keys"])

    def add(table: pa.Table) -> pa.Table:
        parts, owners = [], []
        for value in table.column("keys"):
            planes = np.frombuffer(zstandard.decompress(value.as_buffer()), np.uint8).reshape(5, -1)
            parts.append(np.ascontiguousarray(planes[:4].T).view(np.uint32).ravel())
            owners.append(planes[4])
        every = np.concatenate(parts)
        order = np.argsort(every)
        ranked = every[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(np.concatenate(owners)[order].astype(np.int64), new)
        label = np.empty(len(every), np.uint8)
        label[order] = np.repeat(np.ceil(np.log2(total)).astype(np.uint8), np.diff(np.append(new, len(every))))
        classes = np.split(label, np.cumsum([len(p) for p in parts])[:-1])
        return pa.table({"shard": table.column("shard"), "slice": table.column("slice"), "classes": pa.array(
            [zstandard.compress(c.tobytes(), 1) for c in classes], pa.binary())})

    sent = payloads.mapInArrow(send, "shard long, slice long, keys binary")
    counted = stored(sent.groupBy("shard").applyInArrow(add, "shard long, slice long, classes binary"), "classes")
    return counted.groupBy("slice").agg(F.collect_list(F.struct("shard", "classes")).alias("answers"))


def classes_of(keys: np.ndarray, answers: list[dict], shards: int) -> np.ndarray:
    """The class of each of a slice's distinct keys, from its answers."""
    shard = shard_of(keys, shards)
    out = np.zeros(len(keys), np.uint8)
    for a in answers:
        out[shard == a["shard"]] = np.frombuffer(zstandard.decompress(a["classes"]), np.uint8)
    return out


def map_texts(documents: DataFrame, fn: Callable[[pa.Array], list[pa.Array]], fields: T.StructType,
              text: str = "text", keep: list[str] | None = None,
              limit: int = textscan.SLICE_BYTES) -> DataFrame:
    """Run ``fn`` over bounded slices of the text column inside tasks.

    ``fn`` gets an Arrow string array and returns one array per field.  The result has
    the kept columns (default: all) in ``row`` and the new ones in ``out``, so names
    cannot clash.
    """
    rows, kept = text_rows(documents, text, keep)
    schema = T.StructType([T.StructField("row", kept), T.StructField("out", fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, limit):
            out = pa.StructArray.from_arrays(fn(text_of(batch)), names=fields.fieldNames())
            yield pa.RecordBatch.from_arrays([own_columns(batch, kept), out], names=["row", "out"])

    return rows.mapInArrow(run, schema)
