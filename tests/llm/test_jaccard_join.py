import random
import re

import numpy as np
import pytest

from creditscope.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    ids = sorted(sets)
    label = {i: i for i in ids}
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b for s in sets[a] for t in sets[b]
             if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as label")
    got = jaccard_join.classes(df).collect()
    label = brute(rows)
    want = sorted((str(i), len(shingles(t)), str(label.get(i))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    return label


def corpus(seed, n, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            base = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 2)):
                if base:
                    base[rng.randrange(len(base))] = rng.choice(words)
            if rng.random() < 0.4:
                base += rng.choices(words, k=rng.randint(1, 3))
        else:
            base = rng.choices(words, k=rng.randint(0, size))
        rows.append((i, " ".join(base)))
    return rows


@pytest.mark.parametrize("seed,size", [(1, 14), (2, 40), (3, 120)])
def test_components_match_brute_force(spark, seed, size):
    label = check(spark, corpus(seed, 120, size))
    assert len(set(label.values())) < 110


def test_cluster_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(jaccard_join, "SHINGLES_PER_SHARD", 100)
    check(spark, corpus(5, 100, 60))


def test_all_heavy_and_all_light_agree(spark, monkeypatch):
    rows = corpus(6, 100, 12)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *a, **k: 0)
    check(spark, rows)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *a, **k: 9)
    check(spark, rows)


def test_awkward_rows(spark, awkward, no_rows):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    check(spark, rows)
    assert {r.component_id for r in jaccard_join.classes(awkward).where("doc_id is null").collect()} == {None}
    assert jaccard_join.classes(no_rows).collect() == []


def test_needed_is_the_least_overlap():
    for a in range(1, 40):
        for b in range(1, 40):
            c = jaccard_join.needed(a, b)
            assert 100 * c >= 75 * (a + b - c) and 100 * (c - 1) < 75 * (a + b - c + 1)
            linkable = any(100 * i >= 75 * (a + b - i) for i in range(min(a, b) + 1))
            assert linkable == (b in jaccard_join.partners(a))


def test_boundary_follows_cost():
    assert jaccard_join.boundary({}) == 0
    assert jaccard_join.boundary({3: 1000}) >= 3
    assert jaccard_join.boundary({24: 10**6}) < 24


def test_spanning_links_of_a_cluster():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 400).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.08],
                                      rng.integers(0, 2**63, 10).astype(np.uint64)])) for _ in range(30)]
    found = list(jaccard_join._Cluster(list(range(30)), [0] * 30, sets).links(75))
    assert all(100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in found)
    assert len(found) <= 29


def check_links(spark, rows):
    """n_links is the number of other documents that link, copies among them."""
    sets = {i: shingles(t) for i, t in rows}
    want = {i: sum(1 for j, t in sets.items() if j != i and s and t and 100 * len(s & t) >= 75 * len(s | t))
            for i, s in sets.items()}
    got = {r.doc_id: r.n_links for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    return want


def test_links_match_brute_force(spark, monkeypatch):
    rows = corpus(2, 110, 30)
    rows += [(500 + i, rows[40][1]) for i in range(3)] + [(600, ""), (601, None)]
    base = " ".join(f"b{i}" for i in range(60))
    rows += [(700 + i, f"{base} x{i} y{i}") for i in range(12)]
    want = check_links(spark, rows)
    # More links than the forest of a class has.
    assert all(want[700 + i] == 11 for i in range(12))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    monkeypatch.setattr(jaccard_join, "SHINGLES_PER_SHARD", 100)
    monkeypatch.setattr(jaccard_join, "boundary", lambda *a, **k: 9)
    check_links(spark, rows)


def test_links_of_repeated_ids_and_rows(spark, awkward):
    got = {(r.doc_id, r.n_shingles): r.n_links for r in jaccard_join.classes(awkward).collect()}
    assert got[(3, 1)] == got[(4, 1)] == 1 and got[(0, 0)] == 0 and got[(5, 2)] == 0
    assert [v for (i, _), v in got.items() if i is None] == [None]
