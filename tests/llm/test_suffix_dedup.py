import hashlib
import random

import numpy as np
import pytest

from creditscope.llm import lyndon_sort, suffix_dedup


def test_suffix_arrays_match_sorting():
    rng = random.Random(5)
    texts = [[rng.randint(1, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    texts += [[1] * 60, [1, 2] * 30, list(range(50, 0, -1)), []]
    ended = [t + [0] for t in texts]
    offsets = np.append(0, np.cumsum([len(t) for t in ended]))
    got = lyndon_sort.suffix_arrays(np.array([x for t in ended for x in t]), offsets)
    for t, a, b in zip(ended, offsets[:-1], offsets[1:]):
        assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def brute(rows):
    first = {}
    for i, t in rows:
        data = (t or "").encode()
        for a in range(len(data) - 49):
            w = data[a:a + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for a in range(len(data) - 49):
            f = first.get(data[a:a + 50])
            if f is not None and (i is None or f < i):
                gone[a:a + 50] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((str(i), len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as slice", "'p' as payload", "2 as id")
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(df, keep=["doc_id"])).collect()
    want = brute(rows)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    return sum(w[2] for w in want)


def corpus(seed, letters, n=40):
    rng = random.Random(seed)
    passages = ["".join(rng.choices(letters, k=rng.randint(45, 200))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 20):] if rng.random() < 0.5 else "".join(
            rng.choices(letters, k=rng.randint(0, 120))) for _ in range(rng.randint(0, 5))]
        rows.append((rng.choice([i, i, i, None, 3]) if i % 9 == 0 else i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,letters", [(1, "abcdefgh "), (2, "ab"), (3, "aé中\U0001F600")])
def test_matches_brute_force(spark, seed, letters):
    assert check(spark, corpus(seed, letters)) > 1000


@pytest.mark.parametrize("limit", [60, 400])
def test_divided_texts_agree(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "LONG_TEXT", limit)
    monkeypatch.setattr(suffix_dedup, "LEADERS_PER_SHARD", 50)
    monkeypatch.setattr(suffix_dedup, "SORT_SYMBOLS", 500)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 700)
    check(spark, corpus(4, "abc "))


def test_awkward_rows(spark, awkward, no_rows):
    check(spark, [(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 40_000])
    rows = suffix_dedup.remove_repeats(awkward, as_text=True).collect()
    assert len(rows) == awkward.count()
    assert {len(r.row) for r in rows} == {len(awkward.columns)}
    assert suffix_dedup.remove_repeats(no_rows).collect() == []


def test_text_keeps_whole_characters(spark):
    passage = "é中" * 30
    df = spark.createDataFrame([(1, passage), (2, "ü" + passage[:25] + "ß"), (3, "x" + passage)], "doc_id long, text string")
    kept = {r.row.doc_id: r.out.kept for r in suffix_dedup.remove_repeats(df, as_text=True).collect()}
    assert kept == {1: passage, 2: "üß", 3: "x"}
