"""Suffix-array removal of passages that a document with a smaller id already has.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document
with a smaller id; strings are judged on the input.

1. Documents are packed into slices, a written table.  Every ``LENGTH``-byte window
   is led by the least hash of its ``GRAM``-byte strings; windows with the same
   leader form one stretch of text, and equal windows have equal leaders wherever
   they stand.
2. Leaders are gathered by hash shard; each slice gets back a bit per leader: whether
   another document has it.  Only stretches of shared leaders go on.
3. Distinct stretches, with the least id that has them, are gathered by leader.  The
   stretches of one leader form a text; the texts of a shard are suffix-sorted in
   step by Lyndon groups (``lyndon_sort``).  Runs of neighbouring suffixes that share
   ``LENGTH`` bytes give every window the least id that has it.
4. The ids go back to the slices, which mark and cut.

The stretches of a leader with more than ``LONG_TEXT`` distinct bytes are divided:
windows that hold the bytes left of the leader go by those, the others by the bytes
right of it; this repeats on longer and longer common strings, so a text that is
sorted stays small however frequent a phrase is.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` bytes are kept
whole; a null id is larger than any other and equal ids never cut each other; of
repeated texts the smallest id keeps its bytes; very long texts are slices of their
own; extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditscope.llm import sliced, textscan
from creditscope.llm.lyndon_sort import suffix_arrays
from creditscope.llm.tables import stored, tasks_for

LENGTH = 50
GRAM = 24
#: Leaders per shard of the second and third step.
LEADERS_PER_SHARD = 500_000
BYTES_PER_LEADER = 14
LONG_TEXT = 512
#: Symbols sorted together.
SORT_SYMBOLS = 1 << 20
SLICE_BYTES = 2 << 20
_U = np.uint64
_NEVER = np.iinfo(np.int64).max
_BASE = 0x9E3779B97F4A7C15
#: Positions that are hashed together; a place among them and the next window fits the bits.
PIECE, PIECE_BITS = 1 << 14, 15
_BYTE_HASHES = textscan.mix(np.arange(1, 257, dtype=np.uint64))

OUT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def _gram_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from every position, in pieces that stay in cache."""
    n = len(buf) - size + 1
    out = np.empty(max(n, 0), np.uint64)
    for begin in range(0, n, PIECE):
        part = _piece_hashes(buf[begin:begin + PIECE + size - 1], size)
        out[begin:begin + len(part)] = part
    return out


def _piece_hashes(buf: np.ndarray, size: int) -> np.ndarray:
    """By doubling: hashes of 1, 2, 4, ... bytes, put together for ``size``."""
    part, span = _BYTE_HASHES[buf], 1
    total, width = None, 0  # of the parts taken so far
    while True:
        if size & 1:
            if total is None:
                total = part
            else:
                n = len(part) - width
                total = total[:n] * _U(pow(_BASE, span, 1 << 64))
                total += part[width:]
            width += span
        size >>= 1
        if not size:
            return textscan.mix(total)
        joined = part[:-span] * _U(pow(_BASE, span, 1 << 64))
        joined += part[span:]
        part, span = joined, span * 2


def _leading_places(hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` windows the place of the least of its hashes; the leftmost of
    those that are equal in all but ``PIECE_BITS`` bits."""
    windows = LENGTH - GRAM + 1
    at = np.empty(n, np.int64)
    place = np.arange(1 << PIECE_BITS, dtype=np.uint64)
    for begin in range(0, n, PIECE):
        count = min(PIECE, n - begin)
        # Hash in front, place in the piece behind.
        least = hashes[begin:begin + count + windows - 1] >> _U(PIECE_BITS) << _U(PIECE_BITS)
        least |= place[:len(least)]
        span = 1
        while span * 2 <= windows:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:count], least[windows - span:windows - span + count])
        at[begin:begin + count] = least & _U((1 << PIECE_BITS) - 1)
        at[begin:begin + count] += begin
    return at


class Stretches:
    """The leaders of a slice and the stretches of windows that they lead."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = buf
        self.hashes = hashes = _gram_hashes(buf, GRAM)
        n = len(buf) - LENGTH + 1
        none = np.zeros(0, np.int64)
        self.doc = self.first = self.last = self.lead = none
        self.leader = np.zeros(0, np.uint64)
        if n <= 0:
            return
        at = _leading_places(hashes, n)
        whole = np.ones(n, bool)  # windows that end in their document
        over = np.maximum(offsets[1:] - LENGTH + 1, offsets[:-1])
        over = _ranges(over, offsets[1:] - over)
        whole[over[over < n]] = False
        other = at[1:] != at[:-1]
        start = np.flatnonzero(whole & np.concatenate(([True], other | ~whole[:-1])))
        stop = np.flatnonzero(whole & np.concatenate((other | ~whole[1:], [True])))
        self.first, self.last = start, stop          # first and last window of each stretch
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.leader = hashes[at[start]]
        self.lead = at[start] - start                # place of the leader in the stretch

    def contents(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the given stretches, concatenated, and their sizes."""
        size = self.last[some] - self.first[some] + LENGTH
        return self.buf[_ranges(self.first[some], size)], size


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _string_keys(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key of the string at ``begin`` of ``size`` (GRAM to 2 * LENGTH - GRAM
    bytes), from the hashes of four ``GRAM``-byte strings that cover it."""
    end = begin + size - GRAM
    key = size.astype(np.uint64)
    for step in (0, 17, 34, 2 * LENGTH):
        key = key * _U(0xD6E8FEB86659FD93) + hashes[np.minimum(begin + step, end)]
    return textscan.mix(key)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_NEVER))


def _read(payload: pa.Scalar) -> tuple[pa.RecordBatch, np.ndarray, Stretches]:
    batch = sliced.unpacked(payload)
    buf, offsets = textscan.raw(sliced.text_of(batch))
    return batch, offsets, Stretches(buf, offsets)


def _leaders(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    own = _read(payload)[2]
    return sliced.distinct_keys(own.leader, own.doc)


def _shared_contents(own: Stretches, ids: np.ndarray, shards: int, answers: list[dict]):
    """Distinct shared stretches of a slice by shard: (shard, occurrences, number of
    each occurrence's content, one occurrence of each content, least id of each)."""
    leader = np.unique(own.leader)
    keep = sliced.classes_of(leader, answers, shards) > 0
    taken = np.flatnonzero(keep[np.searchsorted(leader, own.leader)]) if len(leader) else np.zeros(0, np.int64)
    if not len(taken):
        return
    hashes = _string_keys(own.hashes, own.first[taken], own.last[taken] - own.first[taken] + LENGTH)
    to = sliced.shard_of(own.leader[taken], shards)
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        some = taken[part]
        _, sample, number = np.unique(hashes[part], return_index=True, return_inverse=True)
        least = np.full(len(sample), _NEVER)
        np.minimum.at(least, number, ids[own.doc[some]])
        yield int(to[part[0]]), some, number, some[sample], least


def _send_contents(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, _, own = _read(batch.column(1)[i])
            ids, answers = _ids(sliced.field(rows, "id")), batch.column(2)[i].as_py()
            out = []
            for shard, _, _, sample, least in _shared_contents(own, ids, shards, answers):
                data, size = own.contents(sample)
                out.append((shard, zstandard.compress(data.tobytes(), 3), zstandard.compress(np.concatenate(
                    [own.leader[sample].view(np.int64), size, own.lead[sample], least]).tobytes(), 1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(out), pa.int64()),
                 pa.array([o[1] for o in out], pa.binary()), pa.array([o[2] for o in out], pa.binary())],
                names=["shard", "slice", "data", "about"])


def least_ids(data: np.ndarray, begin: np.ndarray, size: np.ndarray, owner: np.ndarray,
              least: np.ndarray) -> np.ndarray:
    """For every window of every piece the least id of the pieces that have it.

    Pieces are ``data[begin:begin + size]``; those of one ``owner`` form a text whose
    suffixes are sorted.  Windows follow piece by piece.
    """
    if not len(size):
        return np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    windows = size - LENGTH + 1
    out = np.repeat(least, windows)
    at_out = np.cumsum(windows) - windows
    text_size = np.bincount(np.unique(owner, return_inverse=True)[1], size + 1)
    # Texts of like size are sorted together; each ends with 0, pieces end with 1.
    begins = np.append(0, np.flatnonzero(np.diff(owner[order])) + 1)
    texts = np.argsort(text_size, kind="stable")
    ends = np.append(begins[1:], len(order))
    cuts = np.searchsorted(np.cumsum(text_size[texts]), np.arange(
        SORT_SYMBOLS, int(text_size.sum()) + SORT_SYMBOLS, SORT_SYMBOLS), side="right")
    for group in np.split(texts, np.unique(np.clip(cuts, 1, len(texts)))[:-1] if len(texts) else []):
        some = order[_ranges(begins[group], ends[group] - begins[group])]
        per_text = ends[group] - begins[group]
        width = size[some] + 1
        last = np.zeros(len(some), bool)
        last[np.cumsum(per_text) - 1] = True
        start = np.cumsum(width) - width
        symbols = np.ones(int(width.sum()), np.int64)
        inside = _ranges(start, size[some])
        symbols[inside] = data[_ranges(begin[some], size[some])].astype(np.int64) + 2
        symbols[(start + size[some])[last]] = 0
        offsets = np.append(0, np.cumsum(np.add.reduceat(width, np.cumsum(per_text) - per_text)))
        ranked = suffix_arrays(symbols, offsets)
        # Windows inside one piece, in suffix order; equal ones are neighbours.
        piece = np.repeat(np.arange(len(some)), width)
        ranked = ranked[ranked + LENGTH <= (start + size[some])[piece[ranked]]]
        if not len(ranked):
            continue
        text = np.repeat(np.arange(len(group)), per_text)[piece[ranked]]
        padded = np.concatenate([symbols.astype(np.uint16), np.zeros(LENGTH, np.uint16)])
        run = np.ones(len(ranked), bool)
        for part in range(1, len(ranked), 1 << 16):
            a, b = ranked[part - 1:part - 1 + (1 << 16)], ranked[part:part + (1 << 16)]
            a = a[:len(b)]
            view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
            run[part:part + len(b)] = (view[a] != view[b]).any(axis=1)
        run[1:] |= text[1:] != text[:-1]
        best = np.minimum.reduceat(least[some][piece[ranked]], np.flatnonzero(run))
        out[at_out[some][piece[ranked]] + ranked - start[piece[ranked]]] = best[np.cumsum(run) - 1]
    return out


def window_ids(data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray,
               common: int, owner: np.ndarray, least: np.ndarray) -> np.ndarray:
    """``least_ids`` of pieces whose owner names the ``common`` bytes at ``anchor``;
    ``hashes`` are those of ``data``'s ``GRAM``-byte strings."""
    if not len(size):
        return np.zeros(0, np.int64)
    # Equal pieces of one owner are one piece with the least id.
    keys = textscan.mix(_string_keys(hashes, begin, size) + textscan.mix(owner.view(np.uint64)))
    _, sample, number = np.unique(keys, return_index=True, return_inverse=True)
    low = np.full(len(sample), _NEVER)
    np.minimum.at(low, number, least)
    begin, size_of, anchor, owner = begin[sample], size[sample], anchor[sample], owner[sample]
    windows = size_of - LENGTH + 1
    place = np.cumsum(windows) - windows
    found = np.empty(int(windows.sum()), np.int64)
    _, text = np.unique(owner, return_inverse=True)
    # The only piece of its owner has no other string beside it.
    alone = np.bincount(text)[text] == 1
    some = np.flatnonzero(alone)
    found[_ranges(place[some], windows[some])] = np.repeat(low[some], windows[some])
    long_ = (np.bincount(text, size_of + 1)[text] > LONG_TEXT) & (common < LENGTH) & ~alone
    some = np.flatnonzero(~long_ & ~alone)
    found[_ranges(place[some], windows[some])] = least_ids(data, begin[some], size_of[some], owner[some], low[some])
    some = np.flatnonzero(long_)
    if len(some):
        left = (LENGTH - common + 1) // 2
        right = LENGTH - common - left + 1
        # Windows that begin at least ``left`` bytes before the common string, then the rest.
        upto = np.clip(anchor[some] - left + 1, 0, windows[some])
        for first, count, move, more in ((np.zeros(len(some), np.int64), upto, -left, left),
                                         (upto, windows[some] - upto, 0, right)):
            has = np.flatnonzero(count > 0)
            b, n = begin[some][has] + first[has], count[has] + LENGTH - 1
            at = anchor[some][has] + move - first[has]
            string = np.full(len(has), common + more)
            name = textscan.mix(_string_keys(hashes, b + at, string) + owner[some][has].view(np.uint64)).view(np.int64)
            found[_ranges((place[some] + first)[has], count[has])] = window_ids(
                data, hashes, b, n, at, common + more, name, low[some][has])
    return found[_ranges(place[number], windows[number])]


def _sort_shard(table: pa.Table) -> pa.Table:
    """One shard: for each slice the least ids of the windows of its stretches."""
    data = [np.frombuffer(zstandard.decompress(x), np.uint8) for x in table.column("data").to_pylist()]
    about = [np.frombuffer(zstandard.decompress(x), np.int64).reshape(4, -1) for x in table.column("about").to_pylist()]
    owner, size, anchor, least = np.concatenate(about, axis=1)
    data = np.concatenate(data)
    ids = window_ids(data, _gram_hashes(data, GRAM), np.cumsum(size) - size, size, anchor, GRAM, owner, least)
    cuts = np.cumsum([int((a[1] - LENGTH + 1).sum()) for a in about])[:-1]
    return pa.table({"shard": table.column("shard"), "slice": table.column("slice"),
                     "ids": pa.array([zstandard.compress(x.tobytes(), 1) for x in np.split(ids, cuts)], pa.binary())})


def _whole_characters(kept: pa.Array) -> pa.Array:
    """As text, without the bytes of characters that were cut apart."""
    try:
        return kept.cast(pa.large_string())  # valid as it is
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "ignore") for x in kept.to_pylist()], pa.large_string())


def _cut(batches: Iterator[pa.RecordBatch], shards: int, kept: T.StructType, as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows, offsets, own = _read(batch.column(0)[i])
            ids = _ids(sliced.field(rows, "id"))
            found = {a["shard"]: a["ids"] for a in batch.column(2)[i].as_py() or []}
            change = np.zeros(len(own.buf) + 1, np.int64)
            for shard, some, number, sample, _ in _shared_contents(own, ids, shards, batch.column(1)[i].as_py() or []):
                windows = (own.last - own.first + 1)[sample]
                least = np.frombuffer(zstandard.decompress(found[shard]), np.int64)
                place = np.cumsum(windows) - windows
                count = windows[number]
                at = _ranges(own.first[some], count)
                gone = at[least[_ranges(place[number], count)] < np.repeat(ids[own.doc[some]], count)]
                np.add.at(change, gone, 1)
                np.add.at(change, gone + LENGTH, -1)
            removed = np.cumsum(change[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(removed)))
            begins = removed.copy()
            begins[1:] &= ~removed[:-1]
            edges = offsets[:-1][offsets[:-1] < len(removed)]
            begins[edges] = removed[edges]
            spans = np.concatenate(([0], np.cumsum(begins)))
            keep = offsets - total[offsets]
            stay = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows.num_rows, [
                None, pa.py_buffer(keep.astype(np.int64).tobytes()), pa.py_buffer(own.buf[~removed].tobytes())])
            out = pa.StructArray.from_arrays(
                [pa.array(np.diff(offsets)), pa.array(np.diff(total[offsets])), pa.array(np.diff(spans[offsets])),
                 _whole_characters(stay).cast(pa.string()) if as_text else stay.cast(pa.binary())],
                names=OUT.fieldNames())
            yield pa.RecordBatch.from_arrays([sliced.own_columns(rows, kept), out], names=["row", "out"])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text: str = "text",
                   keep: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """Columns ``row`` (the kept input columns) and ``out`` (``OUT``; ``kept`` holds the
    bytes that stay; ``as_text``: a string, without characters that were cut apart)."""
    rows, kept = sliced.text_rows(documents, text, keep, id=F.col(f"`{id_col}`").cast("long"))
    slices = sliced.slices(rows, SLICE_BYTES)
    total = slices.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = tasks_for(total // BYTES_PER_LEADER, LEADERS_PER_SHARD)
    payloads = slices.select("slice", "payload")
    classes = stored(sliced.key_classes(payloads, _leaders, shards), "shared")
    contents = payloads.join(classes, "slice").select("slice", "payload", "answers").mapInArrow(
        lambda b: _send_contents(b, shards), "shard long, slice long, data binary, about binary")
    ids = contents.groupBy("shard").applyInArrow(_sort_shard, "shard long, slice long, ids binary")
    found = ids.groupBy("slice").agg(F.collect_list(F.struct("shard", "ids")).alias("found"))
    out = T.StructType([*OUT.fields[:-1], T.StructField("kept", T.StringType() if as_text else T.BinaryType())])
    schema = T.StructType([T.StructField("row", kept), T.StructField("out", out)])
    return payloads.join(classes, "slice", "left").join(found, "slice", "left").select(
        "payload", "answers", "found").mapInArrow(lambda b: _cut(b, shards, kept, as_text), schema)


def digest(cut: DataFrame) -> DataFrame:
    """(row.*, counts, kept_sha256)."""
    return cut.select("row.*", "out.n_bytes", "out.n_removed", "out.n_spans",
                      F.sha2(F.col("out.kept"), 256).alias("kept_sha256"))
