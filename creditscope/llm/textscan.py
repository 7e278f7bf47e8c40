"""Vectorised word scanning of Arrow string columns (used inside tasks).

Words are maximal runs of bytes other than space and 0x09-0x0D; they never cross
a document.  Word and window hashes are 64-bit: a polynomial over random byte
values, finalised with an avalanche mix.  Null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once inside a task; a longer single text is one slice.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
    values[_SPACE] = 0
    return values


_EXACT = _byte_values()
_FOLDED = _EXACT.copy()
_FOLDED[65:91] = _EXACT[97:123]
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on uint64 values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Words:
    buf: np.ndarray      # bytes of the slice
    offsets: np.ndarray  # document i is buf[offsets[i]:offsets[i + 1]]
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # byte after each word
    doc: np.ndarray      # document of each word
    first: np.ndarray    # words of document i are first[i]:first[i + 1]


def as_string(column: pa.Array) -> pa.Array:
    """One contiguous large_string array (nulls become empty ranges)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column."""
    column = as_string(column)
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = raw(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def is_space(buf: np.ndarray) -> np.ndarray:
    """Which bytes are outside words."""
    return _SPACE[buf]


def scan(column: pa.Array) -> Words:
    buf, offsets = raw(column)
    n_docs = len(offsets) - 1
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return Words(buf, offsets, empty, empty, empty, np.zeros(n_docs + 1, np.int64))
    space = _SPACE[buf]
    # A byte begins a word if it is no space and follows a space or a document's start.
    begin = ~space
    begin[1:] &= space[:-1]
    edges = offsets[:-1]
    edges = edges[edges < len(buf)]
    begin[edges] = ~space[edges]
    finish = ~space
    finish[:-1] &= space[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    finish[last] = ~space[last]
    start = np.flatnonzero(begin)
    end = np.flatnonzero(finish) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    return Words(buf, offsets, start, end, doc, first)


def word_hashes(words: Words, fold: bool = False) -> np.ndarray:
    """64-bit hash of each word; ``fold`` lower-cases A-Z first."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    length = words.end - words.start
    power = np.full(int(length.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    at = np.arange(len(words.buf))
    owner = np.repeat(words.start, np.diff(np.append(words.start, len(words.buf))))
    at[words.start[0]:] -= owner
    at[:words.start[0]] = 0
    values = (_FOLDED if fold else _EXACT)[words.buf]
    values *= power[np.minimum(at, len(power) - 1)]
    return mix(np.add.reduceat(values, words.start) + length.astype(np.uint64))


def window_hashes(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``width``-word window inside one document, and the index of
    each window's first word.  Documents with fewer words have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total *= _U(0xD6E8FEB86659FD93)
        total += hashes[j:j + n]
    inside = np.flatnonzero(words.doc[:n] == words.doc[width - 1:])
    return mix(total[inside]), inside
