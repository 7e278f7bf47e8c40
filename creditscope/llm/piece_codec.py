"""SentencePiece encoding and decoding: batched Viterbi, batched merges.

A text becomes a space plus itself, with every space a ``\\u2581``.  No piece has that
mark behind another character, and some bytes are in no piece at all, so texts are
cut there into chunks that can be segmented on their own.  The distinct chunks of a
slice are segmented together: the hash of every substring up to the longest piece is
probed in the sorted piece keys; then chunks of equal length advance in step, a
vectorised maximum over the last piece's length storing a back pointer per byte.
The segmentation has the greatest sum of piece scores; a character that is no piece
becomes its byte pieces, at the score of the least piece less 10.

This is the segmentation of the library for models of unigram type.  For a model of
BPE type the library merges instead: of all neighbours whose concatenation is a piece,
those of the best score first, the leftmost of equals.  Pieces loaded with ``merges``
do the same: the distinct chunks of a slice merge in step, each its own best pair, and
chunks of more than ``LONG_CHARS`` characters merge one by one from a heap.

Defined cases: a null text has null ids and back; an empty text has none; a literal
``\\u2581`` in a text becomes byte pieces, so every text decodes to itself; equal sums
choose the longer last piece; very long chunks are handled whole; repeated rows are
encoded alike; extra columns are carried along.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditscope.llm import textscan
from creditscope.llm.sliced import map_texts

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
#: Bytes of text encoded together.
SLICE_BYTES = 1 << 20
#: Cells of one chunk group's score matrix.
GROUP_CELLS = 1 << 20
#: Chunks of more characters merge one by one; chunks of up to each of these in step.
WIDTHS = (4, 8, 12, 16, 24, 48)
LONG_CHARS = WIDTHS[-1]
MARK = "▁".encode()

#: Piece types of the model file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


#: Model type of the trainer's fields.
BPE = 2
NO_MERGE = np.iinfo(np.int32).max


@dataclass
class Merges:
    """Pairs of symbols that merge.  A symbol is a piece, or a character of pieces that
    is none itself (``ids`` -1); -1 is any other character."""
    chars: np.ndarray      # symbol of each code point
    ids: np.ndarray        # piece of each symbol, -1 at the end for no symbol
    keys: np.ndarray       # sorted (left << 32 | right)
    to: np.ndarray
    rank: np.ndarray       # by falling score
    maybe: np.ndarray = field(repr=False)
    table: dict = field(repr=False, default=None)  # key: (rank, symbol), for single lookups

    @classmethod
    def of(cls, match: list[tuple[bytes, float, int]]) -> Merges:
        words = [plain.decode() for plain, _, _ in match]
        symbol = {w: i for i, w in enumerate(words)}
        for w in words:
            for c in w:
                symbol.setdefault(c, len(symbol))
        chars = np.full(0x110000, -1, np.int32)
        for w, i in symbol.items():
            if len(w) == 1:
                chars[ord(w)] = i
        ids = np.full(len(symbol) + 1, -1, np.int32)
        ids[:len(match)] = [m[2] for m in match]
        rank = np.unique([-m[1] for m in match], return_inverse=True)[1]
        rows = [(symbol[w[:k]] << 32 | symbol[w[k:]], i, rank[i]) for i, w in enumerate(words)
                for k in range(1, len(w)) if w[:k] in symbol and w[k:] in symbol]
        keys, to, rank = (np.array(c, np.int64) for c in zip(*sorted(rows)))
        maybe = np.zeros(1 << 22, bool)
        maybe[cls._slot(keys)] = True
        return cls(chars, ids, keys, to.astype(np.int32), rank.astype(np.int32), maybe)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _BASE) >> np.uint64(42)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; ``NO_MERGE`` for those that stay apart."""
        rank, to = np.full(left.shape, NO_MERGE, np.int32), np.full(left.shape, -1, np.int32)
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        likely = np.flatnonzero((left >= 0) & (right >= 0) & self.maybe[self._slot(keys)])
        at = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
        found = self.keys[at] == keys[likely]
        rank[likely[found]], to[likely[found]] = self.rank[at[found]], self.to[at[found]]
        return rank, to

    def together(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols (padded with -1) merged in step; a symbol stays at the place
        of its first character, the places it takes up besides are -2."""
        n, width = symbols.shape
        sym = np.full((n, width + 1), -1, np.int32)  # the last column is the end, and what is before the begin
        sym[:, :width] = symbols
        right, left = (np.tile(np.arange(width + 1) + d, (n, 1)) for d in (1, -1))
        rank, to = (np.full((n, width + 1), v, np.int32) for v in (NO_MERGE, -1))
        for out, value in zip((rank, to), self.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())):
            out[:, :width] = value.reshape(n, width)
        live = np.arange(n)
        while len(live):
            j = rank[live].argmin(axis=1)  # the leftmost of equals
            some = rank[live, j] < NO_MERGE
            live, j = live[some], j[some]
            k = right[live, j]
            sym[live, j], sym[live, k], rank[live, k] = to[live, j], -2, NO_MERGE
            after, before = right[live, k], left[live, j]
            right[live, j], left[live, after] = after, j
            rank[live, j], to[live, j] = self.find(sym[live, j], sym[live, after])
            rank[live, before], to[live, before] = self.find(sym[live, before], sym[live, j])
        return sym[:, :width]

    def alone(self, symbols: np.ndarray) -> np.ndarray:
        """One row of any length, merged from a heap; the result is that of ``together``."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.to.tolist())))
        sym, n = symbols.tolist(), len(symbols)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
                found = self.table.get(sym[i] << 32 | sym[j])
                if found:
                    heapq.heappush(heap, (found[0], i, j, sym[i], sym[j], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b, to = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or right[i] != j:
                continue
            sym[i], sym[j], right[i] = to, -2, right[j]
            if right[i] < n:
                left[right[i]] = i
            offer(left[i], i)
            offer(i, right[i])
        return np.array(sym, np.int32)


@dataclass
class Pieces:
    """Vocabulary tables, sent to the tasks."""
    ids: np.ndarray        # of the pieces that match text, by sorted key
    keys: np.ndarray
    scores: np.ndarray
    longest: int           # bytes of the longest matching piece
    unknown: float
    byte_ids: np.ndarray   # id of each byte's piece
    alone: np.ndarray      # per byte: in no piece, so chunks end around it
    texts: list[bytes]     # bytes that each id decodes to
    maybe: np.ndarray = field(repr=False, default=None)  # prefilter by the keys' top bits
    merges: Merges | None = None  # encode by merges, not by the greatest sum of scores

    @classmethod
    def load(cls, path: str = MODEL_PATH, merges: bool = False) -> Pieces:
        """``merges``: encode as the library does with a model of BPE type."""
        with open(path, "rb") as f:
            data = f.read()
        rows, model_type = [], None
        for number, value in _fields(data):
            if number == 2:
                model_type = dict(_fields(value)).get(3, model_type)
            if number == 1:
                own = dict(_fields(value))
                score = float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0
                rows.append((own.get(1, b""), score, own.get(3, NORMAL)))
        if merges and (model_type != BPE or any(kind in (USER_DEFINED, UNUSED) for _, _, kind in rows)):
            raise ValueError(f"{path}: merges need a model of BPE type of plain pieces")
        scores = [s for _, s, kind in rows if kind == NORMAL]
        most, least = max(scores), min(scores)
        match, texts, byte_ids = [], [], np.zeros(256, np.int32)
        for i, (piece, score, kind) in enumerate(rows):
            plain = piece.replace(MARK, b" ")
            if kind == BYTE:
                byte_ids[int(piece[3:5], 16)] = i
                texts.append(bytes([int(piece[3:5], 16)]))
                continue
            texts.append(b"" if kind in (CONTROL, UNKNOWN) else plain)
            if kind in (NORMAL, USER_DEFINED) and piece:
                match.append((plain, len(plain) * most - 0.1 if kind == USER_DEFINED else score, i))
        used = np.zeros(256, bool)
        for plain, _, _ in match:
            used[list(plain)] = True
        alone = ~used
        alone[0x80:] = False
        keys = np.concatenate([_keys(np.frombuffer(p, np.uint8)[None, :])[0, -1:] for p, _, _ in match])
        order = np.argsort(keys)
        maybe = np.zeros(1 << 20, bool)
        maybe[keys >> np.uint64(44)] = True
        return cls(np.array([m[2] for m in match], np.int32)[order], keys[order],
                   np.array([m[1] for m in match])[order], max(len(m[0]) for m in match),
                   least - UNKNOWN_PENALTY, byte_ids, alone, texts, maybe, Merges.of(match) if merges else None)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key in the sorted pieces, or -1."""
        out = np.full(len(keys), -1, np.int64)
        likely = np.flatnonzero(self.maybe[keys >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, keys[likely]), len(self.keys) - 1)
        found = self.keys[at] == keys[likely]
        out[likely[found]] = at[found]
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row of bytes (column j: of j + 1 bytes)."""
    total = np.zeros(rows.shape[0], np.uint64)
    out = np.zeros(rows.shape, np.uint64)
    for j in range(rows.shape[1]):
        total = total * _BASE + textscan.mix(rows[:, j].astype(np.uint64) + np.uint64(1))
        out[:, j] = textscan.mix(total + np.uint64(j + 1))
    return out


@dataclass
class Chunks:
    buf: np.ndarray      # bytes with the leading spaces
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray    # chunks of text i are first[i]:first[i + 1]


def _chunks(column: pa.Array, pieces: Pieces) -> Chunks:
    data, offsets = textscan.raw(column)
    sizes = np.diff(offsets)
    shown = (sizes > 0).astype(np.int64)  # an empty text gets no leading space
    begin = np.cumsum(sizes + shown) - (sizes + shown)
    buf = np.full(int((sizes + shown).sum()), 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(begin + shown - offsets[:-1], sizes)
    buf[at] = data
    if not len(buf):
        none = np.zeros(0, np.int64)
        return Chunks(buf, none, none, np.zeros(len(sizes) + 1, np.int64))
    cut = np.zeros(len(buf), bool)
    space = buf == 32
    cut[1:] = space[1:] & ~space[:-1]
    odd = pieces.alone[buf]
    cut |= odd
    cut[1:] |= odd[:-1]
    cut[begin[shown == 1]] = True
    start = np.flatnonzero(cut)
    first = np.searchsorted(start, np.append(begin, len(buf)))
    return Chunks(buf, start, np.diff(np.append(start, len(buf))), first)


def _segment(rows: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of each row (chunks of one length), concatenated, and their counts."""
    n, size = rows.shape
    reach = min(size, pieces.longest)
    starts_char = (rows & 0xC0) != 0x80
    width = np.where(rows < 0x80, 1, np.where(rows < 0xE0, 2, np.where(rows < 0xF0, 3, 4)))
    room = max(reach, min(4, size))
    # place[i, e, l]: piece that ends at byte e and has l + 1 bytes (-1: none, -2: unknown character).
    place = np.full((n, size, room), -1, np.int32)
    score = np.full((n, size, room), -np.inf)
    total = np.zeros((n, size), np.uint64)
    value = textscan.mix(rows.astype(np.uint64) + np.uint64(1))
    for l in range(reach):
        # Substrings of l + 1 bytes by their first byte, extended from those of l bytes.
        total = total[:, :size - l] * _BASE + value[:, l:]
        keys = textscan.mix(total + np.uint64(l + 1))
        found = pieces.probe(keys.ravel()).reshape(keys.shape)
        place[:, l:, l] = found
        score[:, l:, l] = np.where(found >= 0, pieces.scores[found], -np.inf)
    for l in range(min(4, size)):
        r, b = np.nonzero(starts_char[:, :size - l] & (width[:, :size - l] == l + 1))
        lone = place[r, b + l, l] < 0
        place[r[lone], b[lone] + l, l] = -2
        score[r[lone], b[lone] + l, l] = pieces.unknown
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, size), np.int16)
    for e in range(size):
        w = min(e + 1, room)
        # Longest piece first, so that equal sums choose it.
        through = best[:, e - w + 1:e + 1] + score[:, e, w - 1::-1] if w < room or e == w - 1 else \
            best[:, e - w + 1:e + 1] + score[:, e, ::-1]
        pick = np.argmax(through, axis=1)
        best[:, e + 1] = through[np.arange(n), pick]
        back[:, e] = w - 1 - pick
    # Walk back; unknown characters become one token per byte.
    token = np.full((n, size), -1, np.int32)
    end = np.full(n, size - 1)
    live = np.arange(n)
    while len(live):
        e = end[live]
        l = back[live, e].astype(np.int64)
        p = place[live, e, l]
        known = p >= 0
        token[live[known], (e - l)[known]] = pieces.ids[p[known]]
        for k in range(int((l[~known].max(initial=-1))) + 1):
            some = ~known & (l >= k)
            token[live[some], (e - k)[some]] = pieces.byte_ids[rows[live[some], (e - k)[some]]]
        end[live] = e - l - 1
        live = live[end[live] >= 0]
    taken = token >= 0
    return token[taken], taken.sum(axis=1)


def _merged(buf: np.ndarray, start: np.ndarray, length: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the chunks by merges, concatenated, and their counts."""
    merges = pieces.merges
    upto = np.cumsum(length)
    data = buf[np.repeat(start - (upto - length), length) + np.arange(upto[-1])]
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    width = np.diff(np.append(at, len(data)))
    point = np.where(width == 1, data[at], data[at] & (0xFF >> (width + 1))).astype(np.int64)
    for k in range(1, 4):
        more = width > k
        point[more] = point[more] << 6 | (data[at[more] + k] & 0x3F)
    symbol = merges.chars[point]
    size = np.add.reduceat(lead.astype(np.int64), upto - length)
    first = np.cumsum(size) - size
    least = 1
    for most in WIDTHS:
        rows = np.flatnonzero((size > least) & (size <= most))
        for some in np.split(rows, range(GROUP_CELLS // most, len(rows), GROUP_CELLS // most)):
            place = first[some][:, None] + np.arange(most)
            inside = np.arange(most) < size[some][:, None]
            own = np.where(inside, symbol[np.minimum(place, len(symbol) - 1)], -1)
            symbol[place[inside]] = merges.together(own)[inside]
        least = most
    for i in np.flatnonzero(size > LONG_CHARS):
        symbol[first[i]:first[i] + size[i]] = merges.alone(symbol[first[i]:first[i] + size[i]])
    ids = np.where(symbol >= 0, merges.ids[symbol], -1)
    # A character that is no piece becomes one token per byte.
    times = np.where(symbol == -2, 0, np.where(ids >= 0, 1, width))
    place = np.cumsum(times) - times
    out = np.zeros(times.sum(), np.int32)
    out[place[ids >= 0]] = ids[ids >= 0]
    for k in range(4):
        some = (symbol != -2) & (ids < 0) & (width > k)
        out[place[some] + k] = pieces.byte_ids[data[at[some] + k]]
    return out, np.add.reduceat(times, first)


def encode(column: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets of each text)."""
    chunks = _chunks(column, pieces)
    n_texts = len(chunks.first) - 1
    if not len(chunks.start):
        return np.zeros(0, np.int32), np.zeros(n_texts + 1, np.int64)
    words = textscan.Words(chunks.buf, np.zeros(0), chunks.start, chunks.start + chunks.length, None, None)
    _, sample, number = np.unique(_chunk_hashes(words), return_index=True, return_inverse=True)
    start, length = chunks.start[sample], chunks.length[sample]
    if pieces.merges:
        flat, counts = _merged(chunks.buf, start, length, pieces)
        return _spread(flat, counts, np.cumsum(counts) - counts, number, chunks.first)
    tokens: list[np.ndarray] = []
    counts = np.zeros(len(sample), np.int64)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        size = int(length[order[a]])
        group = max(1, GROUP_CELLS // (size * min(size, max(4, pieces.longest))))
        for at in range(a, b, group):
            some = order[at:min(b, at + group)]
            rows = chunks.buf[start[some][:, None] + np.arange(size)]
            ids, counts[some] = _segment(rows, pieces)
            tokens.append(ids)
    flat = np.concatenate(tokens)
    begin = np.zeros(len(sample), np.int64)
    begin[order] = np.cumsum(counts[order]) - counts[order]
    return _spread(flat, counts, begin, number, chunks.first)


def _spread(flat: np.ndarray, counts: np.ndarray, begin: np.ndarray, number: np.ndarray,
            first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of every chunk from those of the distinct ones."""
    times = counts[number]
    place = np.repeat(begin[number] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    upto = np.concatenate(([0], np.cumsum(times)))
    return flat[place], upto[first]


def _chunk_hashes(words: textscan.Words) -> np.ndarray:
    """Hash of every chunk; unlike words, chunks may hold spaces."""
    length = words.end - words.start
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), _BASE)))
    at = np.arange(len(words.buf)) - np.repeat(words.start, length)
    values = textscan.mix(words.buf.astype(np.uint64) + np.uint64(1)) * power[at]
    return textscan.mix(np.add.reduceat(values, words.start) + length.astype(np.uint64))


def decode(ids: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets), without the leading spaces."""
    table = np.frombuffer(b"".join(pieces.texts), np.uint8)
    size = np.array([len(t) for t in pieces.texts], np.int64)
    begin = np.cumsum(size) - size
    length = size[ids]
    place = np.repeat(begin[ids] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    upto = np.concatenate(([0], np.cumsum(length)))[offsets]
    buf = table[place]
    begins = upto[:-1][upto[1:] > upto[:-1]]
    drop = begins[buf[begins] == 32]
    keep = np.ones(len(buf), bool)
    keep[drop] = False
    return buf[keep], upto - np.searchsorted(drop, upto)


def encode_documents(documents: DataFrame, pieces: Pieces, text: str = "text",
                     keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the kept input columns) and ``out.ids``."""
    shared = documents.sparkSession.sparkContext.broadcast(pieces)  # bounded: the vocabulary
    fields = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(column: pa.Array) -> list[pa.Array]:
        ids, offsets = encode(column, shared.value)
        null = pa.compute.is_null(column) if column.null_count else None
        return [_lists(offsets, pa.array(ids, pa.int32()), null)]

    return map_texts(documents, run, fields, text, keep, SLICE_BYTES)


def _lists(offsets: np.ndarray, values: pa.Array, null: pa.Array | None) -> pa.Array:
    offsets = offsets.astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=null) if null is not None \
        else pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def decode_documents(encoded: DataFrame, pieces: Pieces, ids: str = "ids",
                     keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the kept input columns) and ``text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)
    kept = encoded.columns if keep is None else keep
    rows = encoded.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
                          F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                column = batch.column(1)
                lists = column.fill_null([]) if column.null_count else column
                offsets = np.asarray(lists.offsets).astype(np.int64)
                flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
                buf, upto = decode(flat, offsets - offsets[0], shared.value)
                text = pa.LargeStringArray.from_buffers(
                    len(column), pa.py_buffer(upto.astype(np.int64).tobytes()), pa.py_buffer(buf.tobytes()))
                if column.null_count:
                    text = pa.compute.if_else(column.is_null(), pa.scalar(None, pa.large_string()), text)
                yield pa.RecordBatch.from_arrays([batch.column(0), text.cast(pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, schema)
