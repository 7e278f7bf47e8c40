"""Quality classifier: interpolated modified Kneser-Ney on trusted text.

The model predicts the bytes of a text's words, and the words' ends, from the up to
``order - 1`` symbols before them.  With ``across`` the context runs over word ends
back to the text's begin; without it, it starts anew at every word (a begin mark
stands in front), so word order and repetition cannot change a perplexity.  An n-gram
is an integer: a leading 1, then its bytes (so the order is at most 7).  Counts cover
all trusted texts.  An n-gram's shard follows from its third and second last symbols:
its suffixes of three symbols and more and their contexts lie in that shard too, so a
shard derives their counts, continuation counts, contexts and probabilities by itself,
and an n-gram travels once, packed, whatever its order.  The tables of one and two
symbols (at most 65,536 each) are summed over the shards.  To score, the texts are cut
into blocks; a block sends its distinct n-grams to the shards as packed rows, which
stream past the shard's tables, and gets their costs back, so what travels grows with
the distinct n-grams of a block, not with its bytes; n-grams that blocks share are
looked up once for as many blocks as are answered together.  A text is rejected
when its perplexity exceeds its language's quantile over the trusted texts.  Texts
that a model has learned look better than new ones, so the quantiles come from
``FOLDS`` further models, each without the texts of its fold (equal texts share one),
that score their own fold; the documents are scored by the model of all texts.

Defined cases: a null, empty or blank text has a null perplexity and is kept; a
language with too few trusted texts for its quantile uses the larger of their
largest value and the quantile over all languages, and so does a null language;
without enough trusted texts in all nothing is rejected; several labels of one id must all be trusted;
repeated rows are judged alike; extra columns are carried along.

``documents`` must give the same rows in the same order when read again (a table
does); a difference is detected and fails the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditscope.llm import sliced, textscan
from creditscope.llm.tables import free_name, stored, tasks_for

ORDER = 5
#: Order of the model whose context runs over word ends: the most that a key holds.
ACROSS_ORDER = 7
QUANTILE = 0.99
FOLDS = 2
ALL = -1  # the model of all trusted texts
#: Log-perplexities are compared in bins of this width, which bounds the histogram.
BIN = 1e-4
#: Up to so many trusted ids (8 bytes each) travel to the scans; more are joined by shuffle.
BROADCAST_IDS = 4_000_000
#: n-grams that a task gathers before it passes on, or adds up, its partial counts.
PARTIAL = 2_000_000
#: Asked n-grams of one shard that are answered together, each distinct one once.
ASKED = 1_000_000
#: Texts whose events are summed together: their number takes the 7 bits that an n-gram's 57 leave.
TEXTS = 128
#: Trusted text per shard of the tables; scored text per copy of them.
SHARD_BYTES = 2 << 20
COPY_BYTES = 1 << 30
#: Bytes of text in a block: slices of a task that ask for their n-grams together.
BLOCK_BYTES = 16 << 20
#: Costs are whole numbers of this part of a nat, so sums do not depend on their order.
COST_SCALE = 1 << 13
MARK = 32  # begin and end of a word; a space is never inside one
BEGIN = 10  # begin of a text, in front of its first mark; never inside a word either

OUT = T.StructType([T.StructField("perplexity", T.DoubleType()), T.StructField("threshold", T.DoubleType()),
                    T.StructField("kept", T.BooleanType())])


def word_grams(words: textscan.Words, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram of every event of every distinct word, that word's number, the number
    of each word of the texts)."""
    hashes = textscan.word_hashes(words)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    start, length = words.start[first], (words.end - words.start)[first]
    total = length + 2
    begin = np.cumsum(total) - total
    place = np.arange(total.sum()) - np.repeat(begin, total)
    inside = (place > 0) & (place <= np.repeat(length, total))
    symbols = np.full(len(place), MARK, np.uint8)
    symbols[inside] = words.buf[(np.repeat(start, total) + place - 1)[inside]]
    gram = _grams(symbols, begin, total, order)
    event = place > 0
    return gram[event], np.repeat(np.arange(len(first)), total)[event], number


def _grams(symbols: np.ndarray, begin: np.ndarray, total: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each symbol (a byte), not reaching before the begin of
    its sequence; each has ``total`` symbols."""
    # A window of eight symbols ends at each of them: a big-endian number.
    led = np.concatenate([np.zeros(8, np.uint8), symbols])
    gram = np.ndarray(len(symbols), ">u8", led, 1, (1,)).astype(np.uint64).view(np.int64)
    gram &= (1 << (8 * order)) - 1
    gram |= 1 << (8 * order)
    for place in range(order - 1):
        early = begin[total > place] + place
        whole = 1 << (8 * (place + 1))
        gram[early] = (gram[early] & (whole - 1)) | whole
    return gram


def text_grams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of every event of the texts, events of each text): words with one mark
    between them, behind the begin of the text and a mark."""
    buf, offsets = textscan.raw(texts)
    n = len(offsets) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    # Two places in front of every text and one behind it, for its begin and its marks.
    begin = offsets[:-1] + 3 * np.arange(n)
    own = np.ones(len(buf) + 3 * n, bool)
    for place in (begin, begin + 1, begin + 2 + np.diff(offsets)):
        own[place] = False
    symbols = np.full(len(own), MARK, np.uint8)
    symbols[own] = buf
    space = textscan.is_space(symbols)
    symbols[space] = MARK
    # What stays: words, the place behind each, and the two in front of a text with words.
    stays = ~space
    stays[1:] |= ~space[:-1]
    some = begin[np.logical_or.reduceat(stays, begin)]
    symbols[some] = BEGIN
    stays[some] = stays[some + 1] = True
    total = np.add.reduceat(stays, begin, dtype=np.int64)
    symbols = symbols[stays]
    first = (np.cumsum(total) - total)[total > 0]
    gram = _grams(symbols, first, total[total > 0], order)
    event = np.ones(len(gram), bool)
    event[first] = event[first + 1] = False
    return gram[event], np.maximum(total - 2, 0)


def _distinct(texts: pa.Array, order: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of the events of the texts, and how often each occurs."""
    if across:
        return np.unique(text_grams(texts, order)[0], return_counts=True)
    gram, word, number = word_grams(textscan.scan(texts), order)
    times = np.bincount(number, minlength=int(number.max(initial=-1)) + 1)
    keys, inverse = np.unique(gram, return_inverse=True)
    weight = (times[word] if len(word) else word).astype(np.float64)
    return keys, np.bincount(inverse, weight, len(keys)).astype(np.int64)


def _shard_of(gram: np.ndarray, shards: int) -> np.ndarray:
    """By the third and second last symbols."""
    pair = (gram.astype(np.uint64) >> np.uint64(8)) & np.uint64(0xFFFF)
    return (textscan.mix(pair + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes."""
    return zstandard.compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=0))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data))


def _by_shard(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its keys in their order)."""
    shard = _shard_of(keys, shards)
    # Short numbers are sorted by radix.
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for part in np.split(order, edges[1:]) if len(order) else ():
        yield int(shard[part[0]]), part


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct keys of all parts."""
    keys = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (rows of counts)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[..., order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first, axis=-1) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch], order: int, across: bool, shards: int) -> Iterator[pa.RecordBatch]:
    """Packed partial counts by shard of a task's texts (columns text, fold)."""
    keys, counts = np.zeros(0, np.int64), np.zeros((FOLDS, 0), np.int64)

    def out():
        rows = [(shard, _pack_sorted(keys[at]), _pack(counts[:, at].ravel())) for shard, at in _by_shard(keys, shards)]
        columns = zip(*rows) if rows else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))],
                                          names=["shard", "grams", "counts"])

    for batch in _by_fold(textscan.slices(batches)):
        gram, times = _distinct(batch.column(0), order, across)
        new = np.zeros((FOLDS, len(gram)), np.int64)
        new[batch.column(1)[0].as_py()] = times
        keys, counts = _added(np.concatenate([keys, gram]), np.concatenate([counts, new], axis=1))
        if len(keys) > PARTIAL:
            yield out()
            keys, counts = keys[:0], counts[:, :0]
    yield out()


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: the counts of each shard, added up as they come."""
    shard, keys, counts, parts = None, None, None, []

    def add():
        nonlocal keys, counts, parts
        keys, counts = _added(np.concatenate([keys, *[k for k, _ in parts]]),
                              np.concatenate([counts, *[c for _, c in parts]], axis=1))
        parts = []

    def out():
        add()
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([_pack_sorted(keys)], pa.binary()),
             pa.array([_pack(counts.ravel())], pa.binary())], names=["shard", "grams", "counts"])

    for batch in batches:
        for own, grams, times in zip(*(c.to_pylist() for c in batch.columns)):
            if own != shard:
                if shard is not None:
                    yield out()
                shard, keys, counts = own, np.zeros(0, np.int64), np.zeros((FOLDS, 0), np.int64)
            parts.append((_unpack_sorted(grams), _unpack(times).reshape(FOLDS, -1)))
            if sum(len(k) for k, _ in parts) > PARTIAL:
                add()
    if shard is not None:
        yield out()


def _by_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one fold each (the last column)."""
    for batch in batches:
        folds = np.asarray(batch.column(batch.num_columns - 1))
        for fold in np.unique(folds):
            yield batch.filter(pa.array(folds == fold))


def _sizes(gram: np.ndarray, order: int) -> np.ndarray:
    """Symbols of each n-gram, from the place of its leading 1."""
    return np.searchsorted(np.array([1 << (8 * n) for n in range(1, order + 1)]), gram, side="right")


def _suffix(gram: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` symbols."""
    return (gram & ((1 << (8 * n)) - 1)) | (1 << (8 * n))


def _types(gram: np.ndarray, n: np.ndarray, order: int, begin: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of a shard's n-grams of one model and their counts: by size from ``order`` down to
    3 the distinct n-grams and their adjusted counts; then the distinct n-grams of two
    symbols and how many of three symbols end in each."""
    gram, n = gram[n > 0], n[n > 0]
    size, out, longer = _sizes(gram, order), {}, np.zeros(0, np.int64)
    for s in range(order, 2, -1):
        types, followed = np.unique(_suffix(longer, s), return_counts=True)
        # A begin has nothing before it: its n-grams keep raw counts, like the longest.
        longer, a = _added(np.concatenate([types, gram[size == s]]), np.concatenate([followed, n[size == s]]))
        out[s] = longer, a
    return (out, *np.unique(_suffix(longer, 2), return_counts=True))


def _models(counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(model, counts): a text counts for every model but its own fold's."""
    total = counts.sum(axis=0)
    yield ALL, total
    for fold in range(FOLDS):
        yield fold, total - counts[fold]


def _statistics(batches: Iterator[pa.RecordBatch], order: int, begin: int) -> Iterator[pa.RecordBatch]:
    """Rows (model, size, gram, c, n).  Size 3 and more: c n-grams have the adjusted count
    ``gram`` (1 to 4).  Below: an n-gram that c longer ones end in, seen n times itself."""
    for batch in batches:
        for packed, times in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gram, rows = _unpack_sorted(packed), []
            size = _sizes(gram, order)
            for model, n in _models(_unpack(times).reshape(FOLDS, -1)):
                types, two, c = _types(gram, n, order, begin)
                for s, (_, a) in types.items():
                    rows.append((model, s, np.arange(1, 5), np.bincount(np.minimum(a, 5), minlength=6)[1:5], np.zeros(4, np.int64)))
                rows.append((model, 2, two, c, np.zeros(len(two), np.int64)))
                for s in (1, 2):
                    own = (size == s) & (n > 0)
                    rows.append((model, s, gram[own], np.zeros(int(own.sum()), np.int64), n[own]))
            columns = [np.concatenate([np.full(len(r[2]), r[i], np.int32) for r in rows]) for i in (0, 1)]
            columns += [np.concatenate([r[i] for r in rows]).astype(np.int64) for i in (2, 3, 4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "size", "gram", "c", "n"])


@dataclass
class Model:
    """Tables of the model of all texts (``ALL``) and of those without a fold."""
    tables: DataFrame    # shard, grams, counts: packed n-grams and their counts by fold
    shards: int
    discounts: dict[int, dict[int, tuple[float, float, float]]]  # by model and size, from 3 on
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by model: probabilities of one and of two symbols
    order: int
    across: bool = False  # the context runs over word ends

    @property
    def begin(self) -> int:
        return BEGIN if self.across else MARK


def discounts_of(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; an empty class leaves its discount at 0."""
    if not n1 or not n2:
        return (0.5, 0.5, 0.5) if n1 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.0), float(i)) for i, d in ((1, 1 - 2 * y * n2 / n1), (2, d2), (3, d3)))


def _interpolated(a: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Probabilities of every symbol (column) in every context (row)."""
    discount = np.array([0.0, *discounts_of(*[int((a == i).sum()) for i in (1, 2, 3, 4)])])[np.minimum(a, 3)]
    total = a.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        p = (np.maximum(a - discount, 0) + discount.sum(axis=1, keepdims=True) * below) / total
    return np.where(total > 0, p, below)


def _short(rows: list, order: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of one and of two symbols, from the statistics of one model."""
    c, n, one = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((1, 256), np.int64)
    for r in rows:
        if r["size"] == 2:
            place = divmod(r["gram"] & 0xFFFF, 256)
            c[place], n[place] = r["c"], r["n"]
        elif r["size"] == 1:
            one[0, r["gram"] & 0xFF] = r["n"]
    if order > 1:
        one = ((c + n) > 0).sum(axis=0, keepdims=True)
    if order > 2:
        c[begin] = n[begin]
    p = _interpolated(one, np.full((1, 256), 1 / 256))
    return p.ravel(), _interpolated(n if order == 2 else c, p).ravel()


def train(trusted: DataFrame, text: str = "text", order: int = ORDER, across: bool = False) -> Model:
    """Sharded counts of all rows of ``trusted``, in all and without each fold."""
    texts = trusted.select(F.col(f"`{text}`").cast("string").alias("text"), _fold(text).alias("fold"))
    shards = tasks_for(texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0, SHARD_BYTES)
    schema, begin = "shard long, grams binary, counts binary", BEGIN if across else MARK
    partial = texts.mapInArrow(lambda b: _count(b, order, across, shards), schema)
    tables = stored(partial.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_add_up, schema), "lm-tables")
    found = tables.mapInArrow(lambda b: _statistics(b, order, begin), "model int, size int, gram long, c long, n long")
    # At most 65,536 rows of two symbols, 256 of one and four per size for each model.
    rows = found.groupBy("model", "size", "gram").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    discounts, short = {}, {}
    for model in range(ALL, FOLDS):
        own = [r for r in rows if r["model"] == model]
        classes = {(r["size"], r["gram"]): r["c"] for r in own if r["size"] > 2}
        discounts[model] = {s: discounts_of(*[classes.get((s, i), 0) for i in (1, 2, 3, 4)]) for s in range(3, order + 1)}
        short[model] = _short(own, order, begin)
    return Model(tables, shards, discounts, short, order, across)


def _fold(text: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{text}`").cast("string")), F.lit(FOLDS)).cast("int")


class _Shard:
    """The tables of one model in one shard."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, order: int, begin: int,
                 discounts: dict[int, tuple[float, float, float]], short: tuple[np.ndarray, np.ndarray]):
        self.order, self.short, self.levels = order, short, {}
        for s, (types, a) in _types(gram, n, order, begin)[0].items():
            if len(types):
                discount = np.array([0.0, *discounts[s]])[np.minimum(a, 3)]
                first = np.flatnonzero(np.append(True, types[1:] >> 8 != types[:-1] >> 8))
                total = np.add.reduceat(a, first)
                each = np.repeat(total, np.diff(np.append(first, len(types))))
                self.levels[s] = (types, np.maximum(a - discount, 0) / each, types[first] >> 8,
                                  np.add.reduceat(discount, first) / total)

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """-ln p of each n-gram, in parts of a nat."""
        size = _sizes(gram, self.order)
        p = np.where(size > 1, self.short[1][gram & 0xFFFF], self.short[0][gram & 0xFF])
        for s in range(3, self.order + 1):
            if s not in self.levels:
                continue
            types, own, contexts, gamma = self.levels[s]
            some = np.flatnonzero(size >= s)
            key = _suffix(gram[some], s)
            # A context that is not there leaves the shorter n-gram's probability.
            at = np.minimum(np.searchsorted(contexts, key >> 8), len(contexts) - 1)
            known = contexts[at] == key >> 8
            some, key, at = some[known], key[known], at[known]
            place = np.minimum(np.searchsorted(types, key), len(types) - 1)
            p[some] = np.where(types[place] == key, own[place], 0.0) + gamma[at] * p[some]
        return np.rint(-np.log(np.maximum(p, 1e-12)) * COST_SCALE).astype(np.int64)


def _answer(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and copy, its tables before the blocks' n-grams: the
    costs, in the order of the n-grams."""
    key, tables, built, asked, size = None, None, {}, {}, 0

    def out():
        # Blocks share most of their n-grams: each is looked up once for all of them.
        nonlocal asked, size
        rows = []
        for fold, blocks in asked.items():
            if fold not in built:
                n = dict(_models(tables[1]))[fold]
                built[fold] = _Shard(tables[0], n, model.order, model.begin, model.discounts[fold], model.short[fold])
            every = _merged([grams for _, grams in blocks])
            cost = built[fold].costs(every)
            rows += [(block, key[0], _pack(cost[np.searchsorted(every, grams)])) for block, grams in blocks]
        asked, size = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))],
                                          names=["block", "shard", "costs"])

    for batch in batches:
        for shard, copy, block, fold, grams, counts in zip(*(c.to_pylist() for c in batch.columns)):
            if (shard, copy) != key:
                if asked:
                    yield out()
                key, built = (shard, copy), {}
                tables = np.zeros(0, np.int64), np.zeros((FOLDS, 0), np.int64)
            if counts is not None:
                tables = _unpack_sorted(grams), _unpack(counts).reshape(FOLDS, -1)
                continue
            asked.setdefault(fold, []).append((block, _unpack_sorted(grams)))
            size += len(asked[fold][-1][1])
            if size > ASKED:
                yield out()
    if asked:
        yield out()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """(block, fold, slices): slices of one fold, about ``BLOCK_BYTES`` of text.  The
    block's number follows from its texts and fold alone."""
    held: dict[int, tuple[xxhash.xxh64, list[pa.RecordBatch], int]] = {}

    def out(fold: int):
        digest, slices, _ = held.pop(fold)
        return digest.intdigest() - (1 << 63), fold, slices

    for batch in _by_fold(sliced.cut(batches)):
        fold = batch.column(2)[0].as_py()
        data, offsets = textscan.raw(sliced.text_of(batch))
        digest, slices, size = held.get(fold, (xxhash.xxh64(seed=fold & 255), [], 0))
        digest.update(data.tobytes())
        digest.update(offsets.tobytes())
        held[fold] = digest, [*slices, batch], size + len(data)
        if held[fold][2] >= BLOCK_BYTES:
            yield out(fold)
    for fold in sorted(held):
        yield out(fold)


def _scored(rows: DataFrame, model: Model, out_schema: T.StructType, finish) -> DataFrame:
    """``rows`` has columns row, name (of the text in it) and fold (of the model that
    scores it); ``finish`` turns (batch, log-perplexities) into the result."""
    order, across, shards = model.order, model.across, model.shards
    ask = Model(None, shards, model.discounts, model.short, order, across)  # without the frame, for the tasks

    def grams(batches):
        for block, fold, slices in _blocks(batches):
            keys = _merged([_distinct(sliced.text_of(batch), order, across)[0] for batch in slices])
            rows = [(shard, block, fold, _pack_sorted(keys[at])) for shard, at in _by_shard(keys, shards)]
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
                names=["shard", "block", "fold", "grams"])

    def payloads(batches):
        for block, _, slices in _blocks(batches):
            for batch in slices:
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sliced.packed(batch)], pa.binary())],
                                                 names=["block", "payload"])

    def score(batches):
        # Rows by block, its costs before its slices.  The slices wait until their n-grams
        # are as many as the costs; blocks of the same texts share a number and these.
        block, costs, wanted, waiting, found, cost = None, {}, 0, [], [], None
        for batch in batches:
            for own, shard, packed, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if own != block:
                    _none_left(waiting)
                    block, costs, wanted, found, cost = own, {}, 0, [], None
                if packed is not None:
                    part = _unpack(packed)
                    wanted += 0 if shard in costs else len(part)
                    costs[shard] = part
                    continue
                waiting.append(sliced.unpacked(payload))
                if cost is None:
                    found.append(_distinct(sliced.text_of(waiting[-1]), order, across)[0])
                    if sum(map(len, found)) < wanted:
                        continue
                    found = [_merged(found)]
                    if len(found[0]) < wanted:
                        continue
                    found = found[0]
                    cost = np.zeros(len(found), np.int64)
                    for s, at in _by_shard(found, shards):
                        if len(costs.get(s, ())) != len(at):
                            _none_left(waiting)
                        cost[at] = costs[s]
                while waiting:
                    slice_ = waiting.pop(0)
                    yield finish(slice_, _log_perplexities(sliced.text_of(slice_), order, across, found, cost))
        _none_left(waiting)

    # The tables come once for every ``COPY_BYTES`` of scored text, blocks are dealt to
    # the copies: no shard's rows gather in one task.
    size = rows.agg(F.sum(F.octet_length(_text_field(rows))).alias("n")).first()["n"] or 0
    copies = tasks_for(size, COPY_BYTES)
    sent = rows.mapInArrow(grams, "shard long, block long, fold int, grams binary")
    sent = sent.select("shard", F.pmod("block", F.lit(copies)).alias("copy"), "block", "fold", "grams",
                       F.lit(None).cast("binary").alias("counts"))
    tables = model.tables.select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"),
        F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("fold"), "grams", "counts")
    met = tables.unionByName(sent).repartition(shards * copies, "shard", "copy").sortWithinPartitions(
        "shard", "copy", F.col("counts").isNull())
    costs = met.mapInArrow(lambda b: _answer(b, ask), "block long, shard long, costs binary")
    back = costs.select("block", "shard", "costs", F.lit(None).cast("binary").alias("payload"))
    blocks = rows.mapInArrow(payloads, "block long, payload binary").select(
        "block", F.lit(None).cast("long").alias("shard"), F.lit(None).cast("binary").alias("costs"), "payload")
    both = back.unionByName(blocks).repartition("block").sortWithinPartitions("block", F.col("payload").isNotNull())
    return both.mapInArrow(score, out_schema)


def _none_left(waiting: list) -> None:
    if waiting:
        raise RuntimeError("the documents changed between two reads of them")


def _text_field(rows: DataFrame) -> Column:
    """The text of text rows, whichever field holds it."""
    names = rows.schema["row"].dataType.fieldNames()
    return F.coalesce(*[F.when(F.col("name") == n, F.col(f"row.{n}").cast("string")) for n in names
                        if rows.schema["row"].dataType[n].dataType == T.StringType()])


def _totals(texts: pa.Array, order: int, found: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost of each text's events, and how many they are; words in their context."""
    total, times, low = [np.zeros(0)], [np.zeros(0, np.int64)], np.uint64(TEXTS - 1)
    for at in range(0, len(texts), TEXTS):
        gram, n = text_grams(texts.slice(at, TEXTS), order)
        # One sort of whole numbers: the n-gram, below it the text.
        event = gram.view(np.uint64) * np.uint64(TEXTS)
        event |= np.repeat(np.arange(len(n), dtype=np.uint64), n)
        event.sort()
        doc = (event & low).astype(np.uint8)
        event //= np.uint64(TEXTS)
        first = np.flatnonzero(np.append(True, event[1:] != event[:-1])) if len(event) else np.zeros(0, np.int64)
        each = _cost_of(event[first].view(np.int64), found, cost).astype(np.float64)
        # Sums of whole numbers, so their order does not matter.
        total.append(np.bincount(doc, np.repeat(each, np.diff(np.append(first, len(event)))), len(n)))
        times.append(n)
    return np.concatenate(total), np.concatenate(times)


def _log_perplexities(texts: pa.Array, order: int, across: bool, found: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Mean cost per event of each text in nats; NaN without events."""
    if across:
        total, times = _totals(texts, order, found, cost)
    else:
        words = textscan.scan(texts)
        gram, word, number = word_grams(words, order)
        n = int(number.max(initial=-1)) + 1
        per_word, events = np.bincount(word, _cost_of(gram, found, cost), n), np.bincount(word, minlength=n)
        total, times = (np.bincount(words.doc, x[number], len(texts)) for x in (per_word, events))
    with np.errstate(invalid="ignore"):
        return np.where(times > 0, total / times / COST_SCALE, np.nan)


def _cost_of(gram: np.ndarray, found: np.ndarray, cost: np.ndarray) -> np.ndarray:
    at = np.searchsorted(found, gram)
    if len(gram) and (at.max() >= len(found) or (found[at] != gram).any()):
        raise RuntimeError("the documents changed between two reads of them")
    return cost[at]


def thresholds(trusted: DataFrame, model: Model, text: str = "text", lang: str = "lang",
               quantile: float = QUANTILE) -> dict[str | None, float]:
    """Log-perplexity quantile per language, and over all under the key None."""
    def finish(batch, value):
        return pa.RecordBatch.from_arrays([sliced.field(batch, "lang"), pa.array(value)], names=["lang", "v"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("v", T.DoubleType())])
    rows, _ = sliced.text_rows(trusted, text, [], lang=F.col(f"`{lang}`").cast("string"), fold=_fold(text))
    rows = rows.withColumn("fold", F.col("row.fold"))
    scored = _scored(rows, model, schema, finish).where(~F.isnan("v"))
    binned = scored.groupBy("lang", F.ceil(F.col("v") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    binned = stored(binned, "lm-bins")
    both = binned.select(F.struct("lang").alias("l"), "bin", "n").unionByName(
        binned.groupBy("bin").agg(F.sum("n").alias("n")).select(
            F.lit(None).cast("struct<lang:string>").alias("l"), "bin", "n"))
    upto = Window.partitionBy("l").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.select("l", "bin", F.sum("n").over(upto).alias("upto"),
                         F.sum("n").over(Window.partitionBy("l")).alias("total"))
    # The rank that a new text stays under with the wanted chance; it needs enough texts.
    wanted = F.ceil((F.col("total") + 1) * quantile)
    rows = ranked.groupBy("l").agg(F.min(F.when(F.col("upto") >= wanted, F.col("bin"))).alias("bin"),
                                   F.max("bin").alias("largest")).collect()  # one row per language
    over_all = next((r["bin"] for r in rows if r["l"] is None), None)
    if over_all is None:
        return {}
    out = {None: over_all * BIN}
    for r in rows:
        if r["l"] is not None and r["l"]["lang"] is not None:
            out[r["l"]["lang"]] = (r["bin"] if r["bin"] is not None else max(r["largest"], over_all)) * BIN
    return out


def trusted_documents(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents all of whose labels say quality and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    name = free_name(documents, "trusted_id")
    ids = labels.groupBy(F.col("doc_id").alias(name)).agg(
        F.min(F.coalesce(good, F.lit(False))).alias("g")).where("g").select(name)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return documents.join(ids, F.col(f"`{id_col}`") == F.col(name), "left_semi")


def classify(documents: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang",
             order: int = ORDER, quantile: float = QUANTILE, keep: list[str] | None = None,
             across: bool = False) -> DataFrame:
    """Columns ``row`` (the kept input columns) and ``out`` (``OUT``)."""
    model = train(trusted, text, order, across)
    limits = thresholds(trusted, model, text, lang, quantile)
    rows, kept = sliced.text_rows(documents, text, keep, lang=F.col(f"`{lang}`").cast("string"))
    rows = rows.withColumn("fold", F.lit(ALL).cast("int"))
    schema = T.StructType([T.StructField("row", kept), T.StructField("out", OUT)])

    def finish(batch, value):
        langs = sliced.field(batch, "lang").to_pylist()
        limit = np.array([limits.get(x, limits.get(None, np.inf)) for x in langs], float)
        ok = ~(np.ceil(np.nan_to_num(value) / BIN) * BIN > limit + BIN / 2) | np.isnan(value)
        out = pa.StructArray.from_arrays(
            [pa.array(np.exp(value), mask=np.isnan(value)), pa.array(np.exp(limit), mask=~np.isfinite(limit)),
             pa.array(ok)], names=OUT.fieldNames())
        return pa.RecordBatch.from_arrays([sliced.own_columns(batch, kept), out], names=["row", "out"])

    return _scored(rows, model, schema, finish)
