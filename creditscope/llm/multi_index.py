"""Approximate nearest neighbours by an inverted multi-index.

The two halves of every vector are quantised separately: a vector's cell is the pair
of its halves' nearest centroids.  Cells lie in shards of about ``SHARD_ROWS``
vectors (a large cell is spread over several).  A query orders each half's centroids by
distance (for the inner product: the negated product with its own half) and traverses
pairs by summed distance with a heap until the cells passed hold its share of all
vectors; the entries of those cells, and only those, are ranked by their exact inner product.

Codebooks are fitted on a bounded sample (``SAMPLE`` vectors by hash, in one task), and
so is the share: the least depth at which sampled queries find ``RECALL`` of
their true neighbours within the sample.  All rows are indexed.  On a larger table neighbours are
nearer than in the sample, so the share errs towards more recall.

Equal vectors are one entry with its least ``k`` + 1 ids: no query can use more.
A query takes a floor along: its k-th best score among the sampled vectors of the cells
that it probes, below which nothing needs to leave a task.

Only codebooks, the sample, cell sizes (at most ``MAX_CENTROIDS`` squared) and the share
reach the driver.  Queries travel packed, once to each shard that they probe; an entry
is sent once; a task holds one shard, one block of queries and the best of at most
``HELD_QUERIES`` queries over its shards.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part; vectors of unequal length meet on their common components;
ties go to the smaller id; rows that share the query's id are never its candidates; a
row repeated with its vector counts once, with another vector again; of rows that repeat a query's id the least
vector asks; fewer than k candidates: all of them; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.llm.sliced import packed, unpacked
from creditscope.llm.tables import stored, tasks_for
from creditscope.llm.topk_index import usable

#: Vectors that codebooks and the share are fitted on, and sampled queries.
SAMPLE, SAMPLE_QUERIES = 16_384, 256
MAX_CENTROIDS = 256
ROUNDS = 15
RECALL = 0.96
SHARD_ROWS = 2048
QUERY_ROWS = 256
#: A query passes this many vectors at least.
LEAST_DEPTH = 1024
SHARDS_PER_TASK = 4
HELD_QUERIES = 1 << 16


def matrix(vectors: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of doubles, short ones filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(np.asarray(vectors.offsets))
    out = np.zeros((len(vectors), dims))
    out[np.arange(dims) < sizes[:, None]] = np.asarray(vectors.flatten())
    return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = (x.shape[1] + 1) // 2
    return x[:, :middle], x[:, middle:]


def quantised(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids ** 2).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centroids = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        own = quantised(x, centroids)
        size = np.bincount(own, minlength=len(centroids))
        for j in range(x.shape[1]):
            total = np.bincount(own, x[:, j], len(centroids))
            centroids[:, j] = np.where(size > 0, total / np.maximum(size, 1), centroids[:, j])
    return centroids


def traversal(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    """Cells by ascending summed distance until they hold ``depth`` vectors.

    ``first`` and ``second`` are the distances to either half's centroids.  Each row of
    the sorted grid enters the heap when the row before it is opened, so the heap holds
    one pair per opened row."""
    by_a, by_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_a].tolist(), second[by_b].tolist()
    rows, columns, k = by_a.tolist(), by_b.tolist(), len(b)
    heap, out, passed, size = [(a[0] + b[0], 0, 0)], [], 0, sizes.tolist()
    while heap and passed < depth:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * k + columns[j]
        if size[cell]:
            out.append(cell)
            passed += size[cell]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < k:
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return np.array(out, np.int64)


def fitted(x: np.ndarray, centroids: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Codebooks of both halves, and the share of all vectors that a query has to pass
    so that ``RECALL`` of the true neighbours of sampled queries are passed."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    books = [lloyd(half, min(centroids, len(x)), rng) for half in halves(x)]
    cell = quantised(halves(x)[0], books[0]) * len(books[1]) + quantised(halves(x)[1], books[1])
    asked = x[:SAMPLE_QUERIES]
    near = [-(h @ b.T) for h, b in zip(halves(asked), books)]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    wanted = min(k, len(x) - 1)
    if wanted < 1:
        return books[0], books[1], 1.0
    depths = []
    for i in range(len(asked)):
        distance = (near[0][i][:, None] + near[1][i][None, :]).ravel()[cell]
        best = np.argpartition(-score[i], wanted - 1)[:wanted]
        depths.append(np.searchsorted(np.sort(distance), distance[best], side="right") / len(x))
    return books[0], books[1], float(np.quantile(np.concatenate(depths), RECALL))


class MultiIndex:
    """Codebooks, cell sizes and shards of an indexed table (all bounded)."""

    def __init__(self, first: np.ndarray, second: np.ndarray, share: float, ids: np.ndarray, sample: np.ndarray):
        self.books, self.share, self.dims = (first, second), share, sample.shape[1]
        self.cells = len(first) * len(second)
        self.sample, at = np.unique(sample, axis=0, return_index=True)
        self.sample_ids, self.sample_cells = ids[at], self.cell_of(self.sample)

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        one, two = (quantised(h, b) for h, b in zip(halves(x), self.books))
        return one * len(self.books[1]) + two

    def sized(self, sizes: np.ndarray) -> None:
        self.sizes, self.shard_rows = sizes, SHARD_ROWS
        self.begin = np.cumsum(sizes) - sizes
        self.shards = tasks_for(int(sizes.sum()), SHARD_ROWS)
        self.depth = max(LEAST_DEPTH, int(np.ceil(self.share * sizes.sum())))

    def probes(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
        """(shard, cell) pairs that a query probes, and its floor."""
        one, two = (-(b @ h[0]) for h, b in zip(halves(query[None, :]), self.books))
        cells = traversal(one, two, self.sizes, self.depth)
        low = self.begin[cells] // self.shard_rows
        many = (self.begin[cells] + self.sizes[cells] - 1) // self.shard_rows - low + 1
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        passed = np.zeros(self.cells, bool)
        passed[cells] = True
        known = (self.sample @ query)[passed[self.sample_cells] & (self.sample_ids != query_id)]
        floor = float(np.partition(known, -k)[-k]) if len(known) >= k else -np.inf
        return np.repeat(low, many) + at, np.repeat(cells, many), floor


def build(vectors: DataFrame, k: int, seed: int = 17) -> tuple[MultiIndex | None, DataFrame]:
    """The index of ``vectors`` (id, v: array<double>), and its entries as a written
    table (cell, ids: the least k + 1, v)."""
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dims")).first()
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    entries = vectors.withColumn("_r", rank).where(F.col("_r") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_set("id")).alias("ids"))
    if not size["n"]:
        return None, entries.select(F.lit(0).cast("long").alias("cell"), "ids", "v")
    dims = size["dims"]
    count = int(max(1, min(MAX_CENTROIDS, np.sqrt(size["n"] / 4))))
    one_in = max(1, size["n"] // SAMPLE)

    def fit(table: pa.Table) -> pa.Table:
        x = matrix(table.column("v"), dims)
        a, b, share = fitted(x, count, k, seed)
        ids = table.column("id").to_numpy()
        return pa.table({"a": [a.tobytes()], "b": [b.tobytes()], "rows": [len(a)], "share": [share],
                         "ids": [ids.tobytes()], "sample": [x.tobytes()]})

    # By id and vector, so that a vector that many rows share cannot fill the sample.
    sample = vectors.where(F.pmod(F.xxhash64("id", "v"), F.lit(one_in)) == 0)
    got = sample.groupBy(F.lit(0).alias("one")).applyInArrow(
        fit, "a binary, b binary, rows long, share double, ids binary, sample binary").first()
    index = MultiIndex(*(np.frombuffer(got[c]).reshape(got["rows"], -1) for c in "ab"), got["share"],
                       np.frombuffer(got["ids"], np.int64), np.frombuffer(got["sample"]).reshape(-1, dims))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = index.cell_of(matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), batch.column(1)], names=["cell", "ids", "v"])

    table = stored(entries.select("ids", "v").mapInArrow(place, "cell long, ids array<long>, v array<double>"), "entries")
    sizes = np.zeros(index.cells, np.int64)
    for row in table.groupBy("cell").count().collect():  # at most MAX_CENTROIDS squared
        sizes[row["cell"]] = row["count"]
    index.sized(sizes)
    return index, table


def _shards(index: MultiIndex, entries: DataFrame) -> DataFrame:
    """One row per shard: its entries by cell, packed."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.asarray(batch.column(0))
            offset = np.asarray(batch.column(3)).astype(np.uint64) % index.sizes[cell].astype(np.uint64)
            shard = (index.begin[cell] + offset.astype(np.int64)) // index.shard_rows
            yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns[:3]], names=["shard", "cell", "ids", "v"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell").combine_chunks()
        batch = table.select(["cell", "ids", "v"]).to_batches()[0]
        return pa.table({"shard": table.column("shard").slice(0, 1), "entries": pa.array([packed(batch, 1)], pa.binary())})

    spread_rows = entries.select("cell", "ids", "v", F.xxhash64("v").alias("h")).mapInArrow(
        spread, "shard long, cell long, ids array<long>, v array<double>")
    return spread_rows.repartition(index.shards, "shard").groupBy("shard").applyInArrow(pack, "shard long, entries binary")


def _asked(index: MultiIndex, queries: DataFrame, k: int) -> DataFrame:
    """One row per shard and block of queries: the queries that probe it, their cells and floors."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                block = batch.slice(at, QUERY_ROWS)
                x = matrix(block.column(1), index.dims)
                found = [index.probes(i, q, k) for i, q in zip(block.column(0).to_pylist(), x)]
                who = np.repeat(np.arange(len(x)), [len(f[0]) for f in found])
                shard, cell = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                order = np.argsort(shard, kind="stable")
                shard, cell, who = shard[order], cell[order], who[order]
                starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
                rows = []
                for lo, hi in zip(starts, np.append(starts[1:], len(shard))):
                    mine = np.unique(who[lo:hi])
                    lists = [cell[lo:hi][who[lo:hi] == w] for w in mine]
                    rows.append(packed(pa.RecordBatch.from_arrays(
                        [block.column(0).take(pa.array(mine)), pa.array([x[w] for w in mine], pa.list_(pa.float64())),
                         pa.array(lists, pa.list_(pa.int64())), pa.array([found[w][2] for w in mine])],
                        names=["id", "v", "cells", "floor"]), 1))
                yield pa.RecordBatch.from_arrays([pa.array(shard[starts], pa.int64()), pa.array(rows, pa.binary())],
                                                 names=["asked_shard", "queries"])

    return queries.select("id", "v").mapInArrow(probe, "asked_shard long, queries binary")


def _ranked(entries: pa.RecordBatch, queries: pa.RecordBatch, dims: int, k: int):
    """(query id, ids, scores) per query: the best k ids of the probed cells, not below its floor."""
    cell = np.asarray(entries.column(0))
    v, q = matrix(entries.column(2), dims), matrix(queries.column(1), dims)
    lists = queries.column(2)
    who = np.repeat(np.arange(len(q)), np.diff(np.asarray(lists.offsets)))
    probed = np.asarray(lists.flatten())
    order = np.argsort(probed, kind="stable")
    probed, who = probed[order], who[order]
    score = np.full((len(q), len(v)), -np.inf)
    starts = np.flatnonzero(np.append(True, probed[1:] != probed[:-1])) if len(probed) else []
    for lo, hi in zip(starts, np.append(starts[1:], len(probed)) if len(probed) else []):
        a, b = np.searchsorted(cell, [probed[lo], probed[lo] + 1])
        if a < b:
            score[who[lo:hi], a:b] = q[who[lo:hi]] @ v[a:b].T
    ids = entries.column(1)
    id_at, id_values = np.asarray(ids.offsets), np.asarray(ids.flatten())
    slack = 1e-9 * (1 + np.abs(v).sum(1).max(initial=0) * np.abs(q).max(initial=0))
    top = min(k + 1, len(v))
    floor = np.partition(score, len(v) - top, axis=1)[:, len(v) - top] if len(v) else np.zeros(len(q))
    floor = np.maximum(floor, np.asarray(queries.column(3)))
    query_ids = queries.column(0).to_numpy()
    for i in range(len(q)):
        # Those that rounding may move over the floor too, then by sums in one fixed order.
        some = np.flatnonzero((score[i] >= floor[i] - slack) & (score[i] > -np.inf))
        exact = (v[some] * q[i]).sum(axis=1)
        many = id_at[some + 1] - id_at[some]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(id_at[some], many)
        found, value = id_values[at], np.repeat(exact, many)
        other = found != query_ids[i]
        found, value = found[other], value[other]
        best = np.lexsort((found, -value))[:k]
        yield int(query_ids[i]), found[best], value[best]


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of the nearest found, nearest first."""
    def rows(df: DataFrame) -> DataFrame:
        nonzero = F.exists(vector, lambda x: x != 0)
        return df.where(F.col(id_col).isNotNull() & usable(vector) & nonzero).select(
            F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))

    spark = candidates.sparkSession
    index, entries = build(rows(candidates), k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Of rows that repeat a query's id the least vector asks.
    asking = rows(queries).groupBy("id").agg(F.min("v").alias("v")).repartition(
        tasks_for(queries.count(), QUERY_ROWS), "id")
    tasks = tasks_for(index.shards, SHARDS_PER_TASK)
    pairs = _shards(index, entries).repartition(tasks, "shard").join(
        _asked(index, asking, k).repartition(tasks, "asked_shard"), F.col("shard") == F.col("asked_shard"))

    def rows_of(best: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(best), np.int64), [len(b[0]) for b in best.values()])),
             pa.array(np.concatenate([b[0] for b in best.values()])),
             pa.array(np.concatenate([b[1] for b in best.values()]))], names=["query_id", "vec_id", "score"])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for query, ids, score in _ranked(unpacked(batch.column(0)[i]), unpacked(batch.column(1)[i]), index.dims, k):
                    if query in best:
                        ids, score = (np.concatenate(two) for two in zip(best[query], (ids, score)))
                        first = np.lexsort((ids, -score))[:k]
                        ids, score = ids[first], score[first]
                    best[query] = (ids, score)
                if len(best) > HELD_QUERIES:
                    yield rows_of(best)
                    best = {}
        if best:
            yield rows_of(best)

    found = pairs.select("entries", "queries").mapInArrow(rank, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
