"""Ranked lexical search by presence-mask grouping.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased.  One pass over the texts keeps, per slice of documents, the postings
(document, term, occurrences) of terms that some item has, and the counts behind
the weights.  Then every slice is searched: for an item, bitmaps of its terms' postings
are combined into a presence mask per document, documents with equal masks form a
group, and a group can score no more than the sum of its terms' greatest
contributions in the slice.  Groups are scored by descending bound, until no bound left
reaches the item's k-th best score so far (kept over all slices of a task).

Items come in blocks of about ``BLOCK_CHARS`` characters, each with its vocabulary; a
block is broadcast (its size is bounded by that and one item's length) and searched by
a pass of its own, whatever the number of items.  Only the number of blocks and
the two sums behind the weights reach the driver.  A task holds one slice, one block
and k results per item.

Defined cases: a null or empty text has no terms, and such a document is not counted; an
item without terms finds nothing; rows that repeat an item's id ask together; repeated
documents are documents of their own; ties go to the smaller doc_id, null ids last; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.llm import textscan
from creditscope.llm.sliced import packed, unpacked
from creditscope.llm.tables import stored, tasks_for

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
BLOCK_CHARS = 2 << 20
#: Bytes of text in a slice; a longer single text is one slice, read in pieces.
SLICE_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Documents times terms of one item that are marked at once.
MARKS = 1 << 26


def term_counts(text: bytes) -> tuple[int, Counter]:
    """Number of terms and the occurrences of each, piece by piece for a long text."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        to = at + PIECE_BYTES
        if to < len(text):
            stop = BREAK.search(text, to)
            to = stop.start() if stop else len(text)
        counts.update(TERM.findall(text[at:to].lower()))
        at = to
    return counts.total(), counts


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def contributions(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Slice:
    """Postings of one slice by term, with what each adds to a score."""

    def __init__(self, postings: pa.RecordBatch, weight: np.ndarray, documents: int, terms: int):
        ids, n, doc, term, tf = (postings.column(i)[0].values for i in range(5))
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        m = 100 - 50 + 50 * n.to_numpy().astype(np.int64) * documents // max(terms, 1)
        self.doc, self.term = doc.to_numpy(), term.to_numpy()
        self.adds = contributions(weight[self.term], tf.to_numpy().astype(np.int64), m[self.doc])
        self.begin = np.searchsorted(self.term, np.arange(len(weight) + 1))
        most = np.zeros(len(weight), np.int64)
        np.maximum.at(most, self.term, self.adds)
        self.most = most

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores that may belong to the item's best k, all above 0 and at
        least ``floor``."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        many = self.begin[terms + 1] - self.begin[terms]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.begin[terms], many)
        doc, adds, place = self.doc[at], self.adds[at], np.repeat(np.arange(len(terms)), many)
        docs, doc = np.unique(doc, return_inverse=True)
        best_doc, best = [], []
        step = max(64, MARKS // len(terms))
        for lo in range(0, len(docs), step):
            inside = (doc >= lo) & (doc < lo + step)
            found, score = self._grouped(doc[inside] - lo, place[inside], adds[inside], min(step, len(docs) - lo),
                                         self.most[terms], k, floor)
            best_doc.append(docs[lo + found])
            best.append(score)
            if sum(map(len, best)) >= k:
                floor = max(floor, int(np.partition(np.concatenate(best), -k)[-k]))
        doc, score = np.concatenate(best_doc), np.concatenate(best)
        good = score >= max(floor, 1)
        return doc[good], score[good]

    @staticmethod
    def _grouped(doc, place, adds, n: int, most: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        # One bitmap per term; a document's column of bits is its presence mask.
        bitmap = np.zeros((len(most), n), bool)
        bitmap[place, doc] = True
        masks = np.ascontiguousarray(np.packbits(bitmap, axis=0).T)
        distinct, group = np.unique(masks.view(np.dtype((np.void, masks.shape[1]))).ravel(), return_inverse=True)
        bits = np.unpackbits(distinct.view(np.uint8).reshape(len(distinct), -1), axis=1, count=len(most))
        bound = bits.astype(np.int64) @ most
        order = np.argsort(-bound, kind="stable")
        turn = np.empty(len(order), np.int64)
        turn[order] = np.arange(len(order))
        turn = turn[group]  # when each document's group is due
        sizes = np.cumsum(np.bincount(group, minlength=len(order))[order])
        found, scores, done, batch = [], [], 0, k
        while done < len(order) and bound[order[done]] >= max(floor, 1):
            # The next groups that hold about ``batch`` documents and may still matter.
            to = int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + batch)) + 1
            to = max(done + 1, min(to, int(np.searchsorted(-bound[order], -max(floor, 1), side="right"))))
            due = (turn >= done) & (turn < to)
            total = np.zeros(n, np.int64)
            mine = due[doc]
            np.add.at(total, doc[mine], adds[mine])
            found.append(np.flatnonzero(due))
            scores.append(total[due])
            if sum(map(len, scores)) >= k:
                floor = max(floor, int(np.partition(np.concatenate(scores), -k)[-k]))
            done, batch = to, batch * 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(scores)


def item_blocks(items: DataFrame, item: str, text: str) -> tuple[int, DataFrame]:
    """Number of blocks, and a written table (block, payload) of their items and terms."""
    own = items.select(F.col(f"`{item}`").cast("long").alias("item"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("item is not null")
    count = tasks_for(own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], BLOCK_CHARS)

    def pack(table: pa.Table) -> pa.Table:
        wanted: dict[int, set] = {}
        for i, t in zip(table.column("item").to_pylist(), table.column("text").to_pylist()):
            wanted.setdefault(i, set()).update(term_counts(t.encode())[1])
        vocabulary = sorted(set().union(*wanted.values()))
        number = {t: i for i, t in enumerate(vocabulary)}
        ids = sorted(wanted)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([vocabulary], pa.list_(pa.binary())), pa.array([ids], pa.list_(pa.int64())),
             pa.array([[sorted(number[t] for t in wanted[i]) for i in ids]], pa.list_(pa.list_(pa.int32())))],
            names=["vocabulary", "ids", "terms"])
        return pa.table({"block": table.column("block").slice(0, 1), "payload": pa.array([packed(batch)], pa.binary())})

    keyed = own.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(count)))
    return count, stored(keyed.groupBy("block").applyInArrow(pack, "block long, payload binary"), "items")


def _postings(documents: DataFrame, number: int, block: DataFrame, doc: str, text: str) -> DataFrame:
    """A written table of slices: n_docs, n_terms (documents with a term, their terms) and
    the packed postings of the terms of a block (its number and its one row)."""
    own = documents.select(F.col(f"`{doc}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(batch, 1)], pa.binary())],
                                             names=["for_block", "texts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                payload = batch.column(1)[i].as_py()
                if payload != known:
                    known = payload
                    numbers = {t: j for j, t in enumerate(unpacked(batch.column(1)[i]).column(0)[0].as_py())}
                yield _counted(unpacked(batch.column(0)[i]), numbers, number)

    # The block is one row of bounded size.
    rows = own.mapInArrow(cut, "for_block long, texts binary").join(
        F.broadcast(block), F.col("for_block") == F.col("block"))
    return stored(rows.select("texts", "payload", "block").mapInArrow(
        count, "of long, n_docs long, n_terms long, postings binary"), "postings")


def _counted(texts: pa.RecordBatch, numbers: dict[bytes, int], block: int) -> pa.RecordBatch:
    ids, lengths, doc, term, tf = [], [], [], [], []
    n_docs = n_terms = 0
    for i, text in zip(texts.column(0).to_pylist(), texts.column(1).cast(pa.large_binary())):
        n, counts = term_counts(text.as_py() or b"")
        n_docs += n > 0
        n_terms += n
        mine = counts.keys() & numbers.keys()
        if mine:
            doc += [len(ids)] * len(mine)
            term += [numbers[t] for t in mine]
            tf += [counts[t] for t in mine]
            ids.append(i)
            lengths.append(n)
    doc, term, tf = np.array(doc, np.int32), np.array(term, np.int32), np.array(tf, np.int64)
    order = np.lexsort((doc, term))
    one = lambda x, t: pa.array([x], pa.list_(t))
    batch = pa.RecordBatch.from_arrays(
        [one(ids, pa.int64()), one(lengths, pa.int64()), one(doc[order], pa.int32()), one(term[order], pa.int32()),
         one(tf[order], pa.int64())], names=["ids", "n", "doc", "term", "tf"])
    return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (block, n_docs, n_terms)] + [
        pa.array([packed(batch, 1)], pa.binary())], names=["of", "n_docs", "n_terms", "postings"])


def _documents_with(postings: DataFrame) -> DataFrame:
    """One row (in_block, terms, df: arrays) of the block's document frequencies, none if
    no document has a term of it."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for of, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                terms, counts = np.unique(unpacked(payload).column(3)[0].values.to_numpy(), return_counts=True)
                total.update({(of, t): c for t, c in zip(terms.tolist(), counts.tolist())})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.int64()), pa.array([k[1] for k in total], pa.int64()),
                                          pa.array(total.values(), pa.int64())], names=["in_block", "term", "df"])

    sums = postings.select("of", "postings").mapInArrow(add, "in_block long, term long, df long").groupBy(
        "in_block", "term").agg(F.sum("df").alias("df"))
    # As many entries as the block's vocabulary: bounded.
    return sums.groupBy("in_block").agg(F.collect_list(F.struct("term", "df")).alias("counts"))


def _searched(postings: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """(item_id, doc_id, score): per task, the best k documents of every item."""
    n_docs, n_terms = postings.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    block = block.join(_documents_with(postings), F.col("block") == F.col("in_block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        best: list = []
        for batch in batches:
            for i in range(batch.num_rows):
                if items is None:
                    given = unpacked(batch.column(1)[i])
                    items, ids = [np.array(t, np.int64) for t in given.column(2)[0].as_py()], given.column(1)[0].as_py()
                    df = np.zeros(len(given.column(0)[0]), np.int64)
                    counts = batch.column(2)[i].values
                    df[counts.field("term").to_numpy()] = counts.field("df").to_numpy()
                    weight = np.where(df > 0, weights(df, n_docs), 0)
                    best = [[] for _ in ids]
                part = Slice(unpacked(batch.column(0)[i]), weight, n_docs, n_terms)
                for j, terms in enumerate(items):
                    floor = -best[j][k - 1][0] if len(best[j]) >= k else 0
                    doc, score = part.search(terms, k, floor)
                    best[j] = sorted(best[j] + list(zip((-score).tolist(), part.no_id[doc].tolist(),
                                                        part.ids[doc].tolist())))[:k]
        rows = [(i, None if none else d, -s) for i, found in zip(ids, best) for s, none, d in found] if items else []
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)],
                                         names=["item_id", "doc_id", "score"])

    rows = postings.join(F.broadcast(block), F.col("of") == F.col("block"))
    return rows.select("postings", "payload", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def rank(documents: DataFrame, items: DataFrame, k: int = 50, doc: str = "doc_id", item: str = "item_id",
         text: str = "text") -> DataFrame:
    """Rows (item_id, rank, doc_id, score): every item's k best documents with a score above 0."""
    count, blocks = item_blocks(items, item, text)
    parts = []
    for b in range(count):
        block = blocks.where(F.col("block") == b)
        parts.append(_searched(_postings(documents, b, block, doc, text), block, k))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
