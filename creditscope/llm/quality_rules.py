"""Line sequence labelling: a linear-chain CRF marks content and boilerplate lines.

Every line with a word gets binned surface features (length, closing punctuation,
symbols, capitals, digits, repetition inside the line, repeated lines, place in the
text).  Viterbi decoding over the lines of a text gives its best label sequence;
the share of words in content lines decides whether the text stays.  The model is
fitted by penalised likelihood (forward-backward) on at most ``FIT_DOCUMENTS``
labelled texts of at most ``FIT_CHARS`` characters, whose lines take the label of
their text.

Defined cases: null, empty and blank texts have no words and fail the base rule;
very long texts are decoded whole; equal scores prefer content; without any
labelled text every line is content; repeated rows are judged alike; extra columns
are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditscope.llm import textscan
from creditscope.llm.sliced import map_texts

FIT_DOCUMENTS = 2000
FIT_CHARS = 20_000
FIT_STEPS = 150
PENALTY = 1e-3
CONTENT_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SEED = 5

#: Bins of each feature: the first value of every bin but the lowest.
BINS = {
    "words": (2, 4, 8, 16, 32, 64, 128),
    "ends_sentence": (1,),
    "symbol_share": (0.002, 0.02, 0.05, 0.1, 0.2),
    "capital_share": (0.02, 0.1, 0.3, 0.6),
    "digit_share": (0.01, 0.1, 0.3),
    "bang_share": (0.01, 0.05, 0.2),
    "word_repeats": (0.2, 0.5, 0.8),
    "repeated_line": (1,),
    "first": (1,),
    "last": (1,),
}
N_FEATURES = sum(len(b) + 1 for b in BINS.values())

_FLAG = {name: np.zeros(256, np.int8) for name in ("symbol", "capital", "digit", "bang", "letter")}
_FLAG["symbol"][list(b"#*$%&|<>")] = 1
_FLAG["capital"][65:91] = 1
_FLAG["digit"][48:58] = 1
_FLAG["bang"][list(b"!?")] = 1
_FLAG["letter"][np.r_[65:91, 97:123]] = 1
#: UTF-8 continuation bytes are no code points of their own.
_CODE_POINT = np.ones(256, np.int8)
_CODE_POINT[0x80:0xC0] = 0
_IN_WORD = np.where(textscan._SPACE, 0, _CODE_POINT).astype(np.int8)
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True

FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "content_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])


@dataclass
class Model:
    emit: np.ndarray   # (2, N_FEATURES): content, boilerplate
    step: np.ndarray   # (2, 2): from, to
    start: np.ndarray  # (2,)

    @classmethod
    def neutral(cls) -> Model:
        return cls(np.zeros((2, N_FEATURES)), np.zeros((2, 2)), np.zeros(2))


@dataclass
class Lines:
    first: np.ndarray   # lines of document i are first[i]:first[i + 1]
    words: np.ndarray   # words of each line
    bins: np.ndarray    # (n, len(BINS)): feature number of each
    repeated: np.ndarray  # equal to an earlier line of its document


def _per(buf: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(buf) + 1, np.int32)  # a slice is far below 2 ** 31 bytes
    np.cumsum(table[buf], out=total[1:])
    return (total[end] - total[start]).astype(np.int64)


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per key: whether it occurs more than once, and whether it is a later occurrence."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    ranked = keys[order]
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def _in_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return textscan.mix(hashes + textscan.mix(doc.astype(np.uint64) + np.uint64(1)))


def read_lines(words: textscan.Words, hashes: np.ndarray) -> Lines:
    """Lines with a word (split at \\n), their features and repetition."""
    buf, offsets = words.buf, words.offsets
    n_docs = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(buf)]
    if not len(words.start):
        none = np.zeros(0, np.int64)
        return Lines(np.zeros(n_docs + 1, np.int64), none, np.zeros((0, len(BINS)), np.int64), none.astype(bool))
    end = np.append(start[1:], len(buf))
    end = np.where((end > start) & (buf[end - 1] == 10), end - 1, end)
    lo, hi = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    has = hi > lo
    start, end, lo, hi = start[has], end[has], lo[has], hi[has]
    doc = words.doc[lo]
    # Whole-line hash over its bytes, blanks included.
    length = end - start
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), 0x9E3779B97F4A7C15, np.uint64)))
    values = np.zeros(len(buf) + 1, np.uint64)
    inside = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())
    values[inside] = textscan.mix(buf[inside].astype(np.uint64) + np.uint64(1)) * power[
        inside - np.repeat(start, length)]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    line_hash = textscan.mix(sums[end] - sums[start] + length.astype(np.uint64))
    twice, later = _again(_in_doc(line_hash, doc))
    # Words that repeat inside their line.
    line = np.repeat(np.arange(len(start)), hi - lo)
    own = np.concatenate([np.arange(0)]) if not len(line) else np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(len(line))
    _, repeat = _again(_in_doc(hashes[own], line))
    n_words = hi - lo
    chars = np.maximum(1, _per(buf, _CODE_POINT, start, end))
    letters = np.maximum(1, _per(buf, _FLAG["letter"], start, end))
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    place = np.arange(len(doc))
    values_of = {
        "words": n_words,
        "ends_sentence": _STOP[buf[words.end[hi - 1] - 1]],
        "symbol_share": _per(buf, _FLAG["symbol"], start, end) / chars,
        "capital_share": _per(buf, _FLAG["capital"], start, end) / letters,
        "digit_share": _per(buf, _FLAG["digit"], start, end) / chars,
        "bang_share": _per(buf, _FLAG["bang"], start, end) / chars,
        "word_repeats": np.bincount(line, repeat, len(start)) / n_words,
        "repeated_line": twice,
        "first": place == first[doc],
        "last": place == first[doc + 1] - 1,
    }
    bins, base = [], 0
    for name, edges in BINS.items():
        bins.append(base + np.searchsorted(np.array(edges, float), values_of[name].astype(float), side="right"))
        base += len(edges) + 1
    return Lines(first, n_words, np.stack(bins, axis=1), later)


def _lockstep(first: np.ndarray) -> list[np.ndarray]:
    """Line numbers by place: the t-th array has the t-th line of every long enough text."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    return [begin[:np.searchsorted(-count, -t, side="left")] + t for t in range(int(count.max(initial=0)))]


def viterbi(emission: np.ndarray, first: np.ndarray, model: Model) -> np.ndarray:
    """Best label of every line (0 content, 1 boilerplate); all texts advance together."""
    steps = _lockstep(first)
    back = np.zeros(emission.shape, np.int8)
    best = np.zeros(emission.shape)
    for t, at in enumerate(steps):
        if t == 0:
            best[at] = emission[at] + model.start
            continue
        through = best[at - 1][:, :, None] + model.step[None]
        back[at] = np.argmax(through, axis=1)
        best[at] = through.max(axis=1) + emission[at]
    label = np.zeros(len(emission), np.int8)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        going = len(steps[t + 1]) if t + 1 < len(steps) else 0
        label[at[going:]] = np.argmax(best[at[going:]], axis=1)
        if going:
            label[at[:going]] = back[at[:going] + 1, label[at[:going] + 1]]
    return label


def emissions(lines: Lines, model: Model) -> np.ndarray:
    return model.emit[:, lines.bins].sum(axis=2).T


def fit(lines: Lines, label: np.ndarray, steps: int = FIT_STEPS, penalty: float = PENALTY) -> Model:
    """Penalised maximum likelihood by Adam steps with forward-backward expectations."""
    model = Model.neutral()
    n = len(lines.words)
    if not n or len(np.unique(label)) < 2:
        return model
    onehot = np.zeros((n, N_FEATURES))
    onehot[np.arange(n)[:, None], lines.bins] = 1
    target = np.eye(2)[label]
    order = _lockstep(lines.first)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (model.emit, model.step, model.start)]
    for i in range(1, steps + 1):
        emission = emissions(lines, model)
        ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
        for t, at in enumerate(order):
            ahead[at] = emission[at] + (model.start if t == 0 else np.logaddexp.reduce(
                ahead[at - 1][:, :, None] + model.step[None], axis=1))
        for t in range(len(order) - 2, -1, -1):
            at = order[t][:len(order[t + 1])]
            behind[at] = np.logaddexp.reduce(
                model.step[None] + (emission[at + 1] + behind[at + 1])[:, None, :], axis=2)
        joint = ahead + behind
        whole = np.logaddexp.reduce(joint, axis=1, keepdims=True)
        single = np.exp(joint - whole)
        later = np.concatenate(order[1:]) if len(order) > 1 else np.zeros(0, np.int64)
        pair = np.exp(ahead[later - 1][:, :, None] + model.step[None]
                      + (emission[later] + behind[later])[:, None, :] - whole[later][:, :, None])
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[later - 1], label[later]), 1)
        grads = ((target - single).T @ onehot / n - penalty * model.emit,
                 (seen - pair.sum(axis=0)) / n - penalty * model.step,
                 (target - single)[order[0]].sum(axis=0) / n - penalty * model.start)
        for weight, grad, (m, v) in zip((model.emit, model.step, model.start), grads, moments):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            weight += 0.1 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return model


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
          quality: str = "quality") -> Model:
    """Fit on the labelled texts with the smallest seeded hash."""
    known = labels.groupBy(F.col(id_col).alias("i")).agg(F.max(quality).alias("q")).where("q is not null")
    rows = documents.select(F.col(id_col).alias("d"), F.col(text).alias("t")).where(
        F.length("t").between(1, FIT_CHARS)).withColumn("h", F.xxhash64(F.lit(SEED), "d", F.length("t")))
    chosen = rows.select("d", "h").join(known, F.col("d") == F.col("i")).orderBy("h", "d").limit(FIT_DOCUMENTS)
    # Bounded on the driver: FIT_DOCUMENTS texts of FIT_CHARS characters.
    sample = rows.join(F.broadcast(chosen.select("h", "q").distinct()), "h").orderBy("h", "t") \
        .limit(FIT_DOCUMENTS).select("t", "q").collect()
    if not sample:
        return Model.neutral()
    parts = []
    for at in range(0, len(sample), 100):
        words = textscan.scan(pa.array([r["t"] for r in sample[at:at + 100]], pa.large_string()))
        parts.append(read_lines(words, textscan.word_hashes(words)))
    counts = np.concatenate([np.diff(p.first) for p in parts])
    lines = Lines(np.append(0, np.cumsum(counts)), *(np.concatenate([getattr(p, name) for p in parts])
                                                     for name in ("words", "bins", "repeated")))
    label = np.repeat([0 if r["q"] else 1 for r in sample], np.diff(lines.first)).astype(np.int64)
    return fit(lines, label)


def judge(column: pa.Array, model: Model, content_share: float = CONTENT_SHARE) -> list[pa.Array]:
    """The arrays of ``FIELDS`` for a column of texts."""
    words = textscan.scan(column)
    hashes = textscan.word_hashes(words)
    n_docs = len(words.offsets) - 1
    n_words = np.diff(words.first)
    begin, end = words.offsets[:-1], words.offsets[1:]
    windows, at = textscan.window_hashes(words, hashes, WINDOW)
    twice, _ = _again(_in_doc(windows, words.doc[at] if len(at) else at))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = np.bincount(words.doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs) if len(hashes) else np.zeros(n_docs, np.int64)
    lines = read_lines(words, hashes)
    line_doc = np.repeat(np.arange(n_docs), np.diff(lines.first))
    label = viterbi(emissions(lines, model), lines.first, model) if len(lines.words) else np.zeros(0, np.int8)
    content = np.bincount(line_doc, lines.words * (label == 0), n_docs).astype(np.int64)
    dup = np.bincount(line_doc[lines.repeated], minlength=n_docs)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n_words)
    kept = ~failed & (content >= content_share * n_words)
    longs = (n_words, _per(words.buf, _IN_WORD, begin, end), _per(words.buf, _FLAG["symbol"], begin, end), dup, repeated,
             np.diff(lines.first), content)
    return [pa.array(x.astype(np.int64), pa.int64()) for x in longs] + [pa.array(failed), pa.array(kept)]


def label_documents(documents: DataFrame, model: Model, text: str = "text",
                    keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the kept input columns) and ``out`` (``FIELDS``)."""
    return map_texts(documents, lambda column: judge(column, model), FIELDS, text, keep)
