"""N-gram Jaccard join: size-aware heavy-light, components of the links.

A text's set holds its distinct 5-word shingles (64-bit hashes, A-Z lower-cased; a
shorter text is one shingle).  Texts with equal sets are one representative.  Two
sets of sizes a and b link when 100 * common >= 75 * union, that is when they share
o(a, b) = ceil(75 (a + b) / 175) shingles.

*Light* pairs (both sizes up to a boundary): every set enumerates its subsets of size
o(a, b) for each possible partner size; sets that meet in a subset under the same
two sizes are linked.

*Heavy* pairs: linked sets share one of their rarest ``size - ceil(0.75 size) + 1``
shingles.  Shingles are ordered by the class of their count over all texts; those of
them that other texts have are entered in inverted lists.  Lists are scanned shard by
shard and yield, with the light links, candidate clusters, not pairs.  Inside a cluster
each pair of sets of admissible sizes is compared exactly, once: a set's shingles
count the larger sets that have them.  What leaves a cluster is a spanning forest of its
links and each set's number of them, weighted by the copies of the other set;
a cluster beyond ``BLOCK_SHINGLES`` is cut into blocks and every pair of blocks is a
task of its own.  Nothing emits the pairs of a group.

The boundary is the size with the least cost: subsets enumerated below it against
list entries and shipped shingles above it, summed over the table's size histogram.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; a null id gives a row with a null component and number of links; rows that repeat an
id share its node, and each of its different sets counts as a link of others; very long texts are whole sets; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditscope.llm import sliced, textscan
from creditscope.llm.components import components, local_roots
from creditscope.llm.tables import stored, tasks_for

WIDTH = 5
PERCENT = 75
#: Boundaries tried for light sets.
LARGEST_LIGHT = 24
#: Cost of a list entry, in enumerated subsets.
ENTRY_COST = 4
SHINGLES_PER_SHARD = 2_000_000
BYTES_PER_SHINGLE = 6
#: List entries and subset keys that are scanned together.
ENTRIES_PER_SCAN = 1_000_000
BLOCK_SHINGLES = 2_000_000
_U = np.uint64


def needed(a, b, percent: int = PERCENT):
    """Least number of common shingles of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(size, percent: int = PERCENT):
    return size - -(-percent * size // 100) + 1


def partners(size: int, percent: int = PERCENT) -> range:
    return range(-(-percent * size // 100), 100 * size // percent + 1)


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """Light sets have at most this size.  ``histogram``: number of sets of each size up
    to ``LARGEST_LIGHT``; larger ones are heavy at any boundary."""
    def light(s: int, x: int) -> int:
        return sum(comb(s, needed(s, b, percent)) for b in partners(s, percent) if b <= x)

    def heavy(s: int) -> int:
        return ENTRY_COST * prefix_length(s, percent) + s

    def cost(x: int) -> int:
        least = -(-percent * (x + 1) // 100)
        return sum(n * (light(s, x) if s <= x else 0) + n * (heavy(s) if s >= least else 0)
                   for s, n in histogram.items())

    return min(range(LARGEST_LIGHT + 1), key=cost)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words = textscan.scan(column)
    hashes = textscan.word_hashes(words, fold=True)
    windows, at = textscan.window_hashes(words, hashes, WIDTH)
    n_docs = len(words.offsets) - 1
    bounds = np.searchsorted(words.doc[at] if len(at) else at, np.arange(n_docs + 1))
    sets = [np.unique(windows[bounds[i]:bounds[i + 1]]) for i in range(n_docs)]
    count = np.diff(words.first)
    for i in np.flatnonzero((count > 0) & (count < WIDTH)):
        total = _U(count[i])
        with np.errstate(over="ignore"):
            for h in hashes[words.first[i]:words.first[i + 1]]:
                total = total * _U(0xA0761D6478BD642F) + h
        sets[i] = textscan.mix(np.array([total], np.uint64))
    return sets


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    one = textscan.mix(own ^ _U(0x5851F42D4C957F2D))
    two = textscan.mix(own + _U(0x14057B7EF767814F))
    return int(one.sum().view(np.int64)), int(two.sum().view(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and slice of every text of the slices."""
    for batch in batches:
        for number, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = sliced.unpacked(value)
            sets = shingle_sets(sliced.text_of(rows))
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [sliced.field(rows, "c0"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                 pa.array([number] * len(sets), pa.int64())],
                names=["id", "n", "x", "y", "slice"])


def _distinct_sets(payload: pa.Scalar) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and sets of the texts of a slice; of equal sets one, with its least id."""
    rows = sliced.unpacked(payload)
    ids = sliced.field(rows, "c0")
    known = np.asarray(ids.is_valid())
    ids = np.asarray(ids.fill_null(0)).astype(np.int64)
    sets = shingle_sets(sliced.text_of(rows))
    first: dict[tuple, int] = {}
    for i in np.argsort(ids, kind="stable"):
        if known[i] and len(sets[i]):
            first.setdefault(_fingerprint(sets[i]), int(i))
    keep = sorted(first.values())
    return ids[keep], [sets[i] for i in keep]


def _shingles(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a slice and how many of its distinct sets have each."""
    sets = _distinct_sets(payload)[1]
    return np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)


def _prefix(own: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Those of the set's rarest shingles that other texts have."""
    length = prefix_length(len(own), percent)
    order = np.argsort(rank, kind="stable")[:length]
    return own[order[rank[order] > 0]]


def _light_keys(own: np.ndarray, largest: int, percent: int) -> Iterator[tuple[int, int]]:
    """(key of a subset under two sizes; 0: this set is the smaller one, 1: the larger, 2: equal)."""
    size = len(own)
    with np.errstate(over="ignore"):
        for b in partners(size, percent):
            if b > largest:
                continue
            subsets = np.array(list(combinations(range(size), needed(size, b, percent))))
            total = np.full(len(subsets), _U(min(size, b) * 64 + max(size, b)), np.uint64)
            for column in subsets.T:
                total = textscan.mix(total * _U(0xE7037ED1A0B428DB) + own[column])
            for key in total:
                yield int(key), 2 if size == b else int(size > b)


def _packed(shard: np.ndarray, shards: int, columns: list[np.ndarray], kind: int) -> Iterator[tuple]:
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        part = order[edges[s]:edges[s + 1]]
        if len(part):
            yield s, kind, len(part), zstandard.compress(np.stack([c[part] for c in columns]).tobytes(), 1)


def _entries(batches: Iterator[pa.RecordBatch], light: int, shards: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Packed rows per shard.  kind 0: list entries (shingle, id); kind 1: subset keys
    (key, id, side); kind 2 (shard -1): candidate edges found inside the slice."""
    least = -(-percent * (light + 1) // 100)
    for payload, answers in ((p, a) for batch in batches for p, a in zip(batch.column(1), batch.column(2))):
        ids, sets = _distinct_sets(payload)
        rows: list[tuple] = []
        if sets:
            every, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            rank = sliced.classes_of(every, answers.as_py(), shards)[inverse]
            ends = np.cumsum([len(s) for s in sets])
            heavy = [i for i, s in enumerate(sets) if len(s) >= least]
            prefixes = [_prefix(sets[i], rank[ends[i] - len(sets[i]):ends[i]], percent) for i in heavy]
            owner = np.repeat(np.arange(len(heavy)), [len(p) for p in prefixes])
            token = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            same = token[1:] == token[:-1]
            roots = local_roots(owner[:-1][same], owner[1:][same], len(heavy))
            own = ids[heavy]
            moved = np.flatnonzero(roots != np.arange(len(heavy)))
            if len(moved):
                rows.append((-1, 2, len(moved), zstandard.compress(
                    np.stack([own[moved], own[roots[moved]]]).tobytes(), 1)))
            if len(token):
                # Texts that a list of the slice joins enter other lists under one id.
                first = np.append(True, ~same)
                token, member = token[first], own[roots[owner[first]]]
                rows += _packed((token % _U(shards)).astype(np.int64), shards, [token.view(np.int64), member], 0)
        small = [(k, int(i), side) for i, s in zip(ids, sets) if len(s) <= light
                 for k, side in _light_keys(s, light, percent)]
        if small:
            key = np.array([k for k, _, _ in small], np.uint64)
            rows += _packed((key % _U(shards)).astype(np.int64), shards,
                            [key.view(np.int64), np.array([i for _, i, _ in small], np.int64),
                             np.array([b for _, _, b in small], np.int64)], 1)
        if rows:
            shard, kind, n, packed = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int8()), pa.array(n, pa.int64()),
                                              pa.array(packed, pa.binary())], names=["shard", "kind", "n", "packed"])


def _star(key: np.ndarray, member: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each id to the least id that shares keys with it."""
    nodes, at = np.unique(member, return_inverse=True)
    roots = local_roots(at[:-1][joined], at[1:][joined], len(nodes))
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _scan_lists(table: pa.Table) -> pa.Table:
    """One scan: candidate edges (kind 2) of its lists and links (kind 3) of its subsets."""
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    kinds = np.asarray(table.column("kind"))
    packed = table.column("packed")
    for kind, width in ((0, 2), (1, 3), (2, 2)):
        parts = [np.frombuffer(zstandard.decompress(packed[int(i)].as_py()), np.int64).reshape(width, -1)
                 for i in np.flatnonzero(kinds == kind)]
        if not parts:
            continue
        rows = np.concatenate(parts, axis=1)
        if kind == 2:
            out.append((2, rows[0], rows[1]))
            continue
        order = np.argsort(rows[0], kind="stable")
        rows = rows[:, order]
        joined = rows[0, 1:] == rows[0, :-1]
        if kind == 0:
            out.append((2, *_star(rows[0], rows[1], joined)))
            continue
        # A subset under two different sizes links only if both sizes are there.
        group = np.cumsum(np.append(0, ~joined)) if len(order) else np.zeros(0, np.int64)
        sides = np.zeros((int(group.max(initial=-1)) + 1, 3), bool)
        sides[group, rows[2]] = True
        links = (sides[:, 2] | (sides[:, 0] & sides[:, 1]))[group]
        out.append((3, *_star(rows[0], rows[1], joined & links[1:])))
    if not out:
        out = [(2, np.zeros(0, np.int64), np.zeros(0, np.int64))]
    return pa.table({"kind": pa.array(np.concatenate([np.full(len(a), k, np.int8) for k, a, _ in out])),
                     "a": pa.array(np.concatenate([a for _, a, _ in out])),
                     "b": pa.array(np.concatenate([b for _, _, b in out]))})


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) of the ids that a slice is asked for."""
    for batch in batches:
        for payload, wanted in zip(batch.column(0), batch.column(1)):
            rows = sliced.unpacked(payload)
            ids = sliced.field(rows, "c0")
            asked = pc.is_in(ids, value_set=wanted.values)
            yield pa.RecordBatch.from_arrays([ids.filter(asked), sliced.text_of(rows).filter(asked)], names=["id", "text"])


class _Cluster:
    """The sets of one block (or of a pair of blocks) of a candidate cluster."""

    def __init__(self, ids: list[int], sides: list[int], sets: list[np.ndarray], weights: list[int] | None = None,
                 across: bool | None = None):
        order = np.argsort([len(s) for s in sets], kind="stable")
        self.order = order
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.side = np.array([sides[i] for i in order])
        self.size = np.array([len(s) for s in self.sets], np.int64)
        self.weight = np.array([1 if weights is None else weights[i] for i in order], np.int64)
        self.across = len(np.unique(self.side)) > 1 if across is None else across
        self.links_of = np.zeros(len(ids), np.int64)  # weighted number of links, by size order

    def links(self, percent: int) -> Iterator[tuple[int, int]]:
        """A spanning forest of the links between the sets (across sides, if two); all
        links are counted in ``links_of``."""
        n = len(self.ids)
        if n < 2:
            return
        _, token = np.unique(np.concatenate(self.sets), return_inverse=True)
        upto = np.cumsum(self.size)
        owner = np.repeat(np.arange(n, dtype=np.int32), self.size)
        # The sets of each token, by size; ``at`` moves behind the sets already compared.
        having = owner[np.argsort(token, kind="stable")]
        last = np.cumsum(np.bincount(token))
        at = np.append(0, last[:-1])
        label = np.arange(n)
        for i in range(n - 1):
            own = token[upto[i] - self.size[i]:upto[i]]
            at[own] += 1
            # Sorted by size, so the partners of i are a range behind it.
            to = int(np.searchsorted(self.size, 100 * self.size[i] // percent, side="right"))
            own = own[at[own] < last[own]]
            length = last[own] - at[own]
            place = np.repeat(at[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            common = np.bincount(having[place], minlength=n)[i + 1:to]
            good = common >= needed(self.size[i + 1:to] + self.size[i], 0, percent)
            if self.across:
                good &= self.side[i + 1:to] != self.side[i]
            linked = np.flatnonzero(good) + i + 1
            self.links_of[i] += self.weight[linked].sum()
            self.links_of[linked] += self.weight[i]
            new = linked[label[linked] != label[i]]
            while len(new):
                label[label == label[new[0]]] = label[i]
                yield self.ids[i], self.ids[new[0]]
                new = new[label[new] != label[i]]


COMPARED = "a long, b long, n long, x long, y long, links long"


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, i, j): the links of each group, one group at a time, as
    edges (a, b) of a forest and numbers of links of sets (n, x, y)."""
    def out(key: tuple, group: list[tuple]) -> pa.RecordBatch:
        sets = shingle_sets(pa.array([g[2] for g in group], pa.large_string()))
        # An id may have several texts: a set counts once, where it is its member's own.
        seen, weights = set(), []
        for g, own in zip(group, sets):
            name = (len(own), *_fingerprint(own))
            weights.append(g[4] if name == g[3] and name not in seen else 0)
            if weights[-1]:
                seen.add(name)
        cluster = _Cluster([g[0] for g in group], [g[1] for g in group], sets, weights, key[1] != key[2])
        found = list(cluster.links(percent))
        counted = [(*group[i][3], int(m)) for i, m in zip(cluster.order, cluster.links_of) if weights[i] and m]
        rows = [(a, b, None, None, None, None) for a, b in found] + [(None, None, *c) for c in counted]
        columns = zip(*rows) if rows else [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                          names=["a", "b", "n", "x", "y", "links"])

    key, group = None, []
    for batch in batches:
        for cluster, i, j, block, own, n, x, y, copies, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (cluster, i, j) != key:
                if group:
                    yield out(key, group)
                key, group = (cluster, i, j), []
            group.append((own, block, text, (n, x, y), copies))
    if group:
        yield out(key, group)


def classes(documents: DataFrame, id_col: str = "doc_id", text: str = "text",
            percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``documents``;
    n_links: other documents whose sets link with this row's, copies among them."""
    texts = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                             F.col(f"`{text}`").cast("string").alias("text"))
    slices = sliced.slices(sliced.text_rows(texts, "text", ["id"])[0])
    payloads = slices.select("slice", "payload")
    sets = stored(payloads.mapInArrow(_profile, "id long, n long, x long, y long, slice long"), "profile")
    # Texts with equal sets: the least id stands for all of them.
    least = sets.where("n > 0 and id is not null").groupBy("n", "x", "y").agg(
        F.min("id").alias("rep"), F.count_distinct("id").alias("copies"))
    least = stored(least, "representatives")
    sizes = least.where(F.col("n") <= LARGEST_LIGHT).groupBy("n").agg(F.count("*").alias("sets"))
    light = boundary({r["n"]: r["sets"] for r in sizes.collect()}, percent)  # LARGEST_LIGHT rows
    total = slices.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = tasks_for(total // BYTES_PER_SHINGLE, SHINGLES_PER_SHARD)
    classes = sliced.key_classes(payloads, _shingles, shards)
    packed = stored(payloads.join(classes, "slice").select("slice", "payload", "answers").mapInArrow(
        lambda b: _entries(b, light, shards, percent), "shard long, kind byte, n long, packed binary"), "entries")
    # A scan takes whole shards; a set then meets its partners in few of them.
    scans = tasks_for(packed.agg(F.sum("n").alias("n")).first()["n"] or 0, ENTRIES_PER_SCAN)
    spread = F.when(F.col("shard") < 0, F.xxhash64("packed")).otherwise(F.col("shard"))
    found = stored(packed.select(F.pmod(spread, F.lit(scans)).alias("scan"), "kind", "packed").groupBy("scan")
                   .applyInArrow(_scan_lists, "kind byte, a long, b long"), "lists")
    # Light links lie in clusters too: their sets meet in several subsets, so they are
    # counted where each pair is compared once.
    clusters = components(found.where("kind in (2, 3)"))
    # Representatives by cluster; a cluster of one has nothing to compare.
    members = least.join(clusters, F.col("rep") == F.col("node")).select(
        "rep", "n", "x", "y", "copies", F.col("label").alias("cluster"))
    totals = members.groupBy("cluster").agg(F.sum("n").alias("w"), F.count("*").alias("m")).where("m > 1").select(
        F.col("cluster").alias("c"), F.ceil(F.col("w") / BLOCK_SHINGLES).alias("blocks"))
    members = members.join(totals, F.col("cluster") == F.col("c"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    own = ["rep", "n", "x", "y", "copies", "cluster"]
    members = members.select(*own, block.alias("block"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    members = stored(members.select(*own, "block", F.least("block", "other").alias("i"),
                                    F.greatest("block", "other").alias("j")), "members")
    # Only the members' texts leave their slices.
    asked = sets.join(members.select("rep").distinct(), F.col("id") == F.col("rep")).groupBy("slice").agg(
        F.collect_set("id").alias("asked"))
    own_texts = payloads.join(asked, "slice").select("payload", "asked").mapInArrow(_texts_of, "id long, text string")
    todo = members.join(own_texts, F.col("rep") == F.col("id")).select(
        "cluster", "i", "j", "block", "id", "n", "x", "y", "copies", "text")
    parts = tasks_for(members.count(), 2000)
    groups = todo.repartition(parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = stored(groups.mapInArrow(lambda b: _compare(b, percent), COMPARED), "links")
    joined = components(links.where("a is not null").select("a", "b").unionByName(
        found.where("kind = 3").select("a", "b")))
    counted = links.where("n is not null").groupBy("n", "x", "y").agg(F.sum("links").alias("links"))
    least = least.join(counted, ["n", "x", "y"], "left")
    labelled = least.join(joined, F.col("rep") == F.col("node"), "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    labelled = labelled.select("n", "x", "y", "rep", n_links.alias("n_links"), F.when(F.col("label").isNull(), F.struct(
        F.col("rep").alias("l"), F.lit(True).alias("own"))).otherwise(F.struct(
            F.col("label").alias("l"), F.lit(False).alias("own"))).alias("label"))
    first = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_set = labelled.join(first, "label").select(
        F.col("n").alias("sn"), F.col("x").alias("sx"), F.col("y").alias("sy"), "component_id", "n_links")
    placed = sets.select("id", "n", "x", "y").join(of_set, (F.col("n") == F.col("sn")) & (F.col("x") == F.col("sx")) & (
        F.col("y") == F.col("sy")), "left")
    return placed.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
                         F.when(F.col("id").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"))
