import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from creditscope.llm import lexical_rank as lr

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(documents, items, k):
    docs = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in documents if t]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c in docs:
            m = 100 - 50 + (50 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def ranked(docs, items, k):
    return sorted((tuple(r) for r in lr.rank(docs, items, k).collect()), key=str)


def corpus(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    words = ["the", "Of", "naïve", "x1", "中文", "über", "rare", "Dog", "cat", "and", "tail"] + [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(1, 80), p=weight / weight.sum())) for _ in range(n)]
    items = [(i, "! ".join(rng.choice(words, rng.integers(1, 30)))) for i in range(25)]
    return list(enumerate(texts)), items


def test_against_brute_force(spark, monkeypatch):
    docs, items = corpus(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 10)
    assert ranked(d, q, 10) == want
    # Many slices and blocks give the same rows.
    monkeypatch.setattr(lr, "SLICE_BYTES", 2000)
    monkeypatch.setattr(lr, "BLOCK_CHARS", 1000)
    assert ranked(d, q, 10) == want


def test_long_texts_in_pieces(monkeypatch):
    text = "Ünï code, and\x7fdel_under\u00a0nbsp 中文字符 aAa1 " * 40
    whole = lr.term_counts(text.encode())
    monkeypatch.setattr(lr, "PIECE_BYTES", 7)
    assert lr.term_counts(text.encode()) == whole
    assert {t.decode(): c for t, c in whole[1].items()} == Counter(TERM.findall(text.translate(LOWER)))


def test_runs_of_marks_agree(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.4, rng.integers(1, 60)) % 40) for _ in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(texts)], names=["id", "text"])
    numbers = {f"t{i}".encode(): i for i in range(40)}
    postings = lr.unpacked(lr._counted(batch, numbers, 0).column(3)[0])
    terms = postings.column(3)[0].values.to_numpy()
    weight = lr.weights(np.bincount(terms, minlength=40), 700)
    part = lr.Slice(postings, weight, 700, sum(lr.term_counts(t.encode())[0] for t in texts))
    for chosen in (np.arange(40), np.array([3]), np.array([1, 2, 9, 30])):
        full = np.zeros(len(part.ids), np.int64)
        inside = np.isin(part.term, chosen)
        np.add.at(full, part.doc[inside], part.adds[inside])
        for marks in (lr.MARKS, 70 * len(chosen)):
            monkeypatch.setattr(lr, "MARKS", marks)
            doc, score = part.search(chosen, 20, 0)
            assert (score == full[doc]).all()
            assert sorted(score)[-20:] == sorted(full[full > 0])[-20:]


def test_groups_below_the_floor_are_not_scored():
    docs = [(i, "common words") for i in range(500)] + [(500 + i, "common rare") for i in range(20)]
    counts = [lr.term_counts(t.encode()) for _, t in docs]
    numbers = {b"common": 0, b"rare": 1}
    texts = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([t for _, t in docs])], names=["id", "text"])
    postings = lr.unpacked(lr._counted(texts, numbers, 0).column(3)[0])
    weight = lr.weights(np.array([520, 20]), 520)
    part = lr.Slice(postings, weight, 520, sum(c[0] for c in counts))
    doc, score = part.search(np.array([0, 1]), 10, 0)
    assert set(part.ids[doc]) == set(range(500, 520)) and len(set(score)) == 1


def test_awkward_rows(spark, awkward, no_rows):
    items = [(1, "One TWO three"), (1, "word"), (2, None), (3, ""), (4, "..."), (None, "word"), (5, "fünf 中文 a"), (6, "x" * 50_000)]
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as block", "'a' as payload", "2 as terms")
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    assert ranked(awkward, q, 50) == brute(docs, items, 50)
    assert ranked(no_rows, q, 50) == [] and ranked(awkward, q.limit(0), 50) == []
    rows = [(i % 70, "equal texts tie") for i in range(140)] + [(None, "equal texts tie")]
    more = rows + [(900 + i, "something else") for i in range(300)]
    same = spark.createDataFrame(more, "doc_id long, text string")
    one = [(1, "tie")]
    assert ranked(same, spark.createDataFrame(one, "item_id long, text string"), 141) == brute(more, one, 141)
