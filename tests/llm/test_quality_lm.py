import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from creditscope.llm import quality_lm as lm


def events(text, order):
    """n-grams (as strings of symbols) of every event."""
    out = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        s = b" " + w + b" "
        out += [s[max(0, i - order + 1):i + 1] for i in range(1, len(s))]
    return out


class Brute:
    """The model by its definition, over strings."""

    def __init__(self, texts, order):
        raw = Counter(g for t in texts for g in events(t, order))
        types = {g[i:] for g in raw for i in range(len(g))}
        left = Counter(g[1:] for g in types if len(g) > 1)
        self.a = {g: raw[g] if len(g) == order or (len(g) > 1 and g[:1] == b" ") else left[g] for g in types}
        self.a = {g: n for g, n in self.a.items() if n}
        self.d = {n: lm.discounts_of(*[sum(1 for g, a in self.a.items() if len(g) == n and a == i)
                                       for i in (1, 2, 3, 4)]) for n in range(1, order + 1)}
        self.total, self.freed = Counter(), defaultdict(float)
        for g, a in self.a.items():
            self.total[g[:-1]] += a
            self.freed[g[:-1]] += self.d[len(g)][min(a, 3) - 1]
        self.known = set(self.total)

    def p(self, g):
        below = self.p(g[1:]) if len(g) > 1 else 1 / 256
        # A context is known by the order of its n-grams.
        if not self.total[g[:-1]]:
            return below
        a = self.a.get(g, 0)
        own = max(0.0, a - self.d[len(g)][min(a, 3) - 1]) if a else 0.0
        return (own + self.freed[g[:-1]] * below) / self.total[g[:-1]]

    def perplexity(self, text, order):
        costs = [-math.log(self.p(g)) for g in events(text, order)]
        return math.exp(sum(costs) / len(costs)) if costs else None


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    syllables = {"en": ["th", "er", "in", "ou", "st"], "de": ["sch", "ei", "ü", "ch", "en"]}
    def make(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, make("en" if i % 3 else "de", rng.randint(5, 40)), "en" if i % 3 else "de") for i in range(300)]
    rows += [(900 + i, "".join(rng.choices("#$%xq7", k=60)), "en") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_probabilities_match_the_definition(corpus):
    df, rows = corpus
    trusted = df.where("doc_id < 300")
    got = lm.classify(df, trusted, order=3, quantile=0.9).collect()
    brute = Brute([t for i, t, _ in rows if i < 300], 3)
    assert len(got) == len(rows)
    for r in got:
        assert r.out.perplexity == pytest.approx(brute.perplexity(r.row.text, 3), rel=1e-4)
        assert r.out.kept == (r.out.perplexity <= r.out.threshold * (1 + 1e-9))
    assert not any(r.out.kept for r in got if r.row.doc_id >= 900)
    assert sum(r.out.kept for r in got if r.row.doc_id < 300) > 260


def test_a_models_words_sum_to_one(corpus):
    _, rows = corpus
    brute = Brute([t for i, t, _ in rows if i < 300], 3)
    for context in (b" t", b"th", b"zz", b" ", b""):
        assert sum(brute.p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_awkward_rows(awkward, no_rows, labels):
    trusted = lm.trusted_documents(awkward, labels)
    assert {r.doc_id for r in trusted.collect()} == {1, 5, 7, 9}  # 3 also has a toxic label
    got = lm.classify(awkward, trusted).collect()
    assert len(got) == awkward.count()
    assert all(r.out.kept and r.out.perplexity is None for r in got if not (r.row.text or "").strip())
    assert len({(r.out.perplexity, r.out.kept) for r in got if r.row.doc_id == 5}) == 1
    assert all(r.out.kept for r in lm.classify(awkward, no_rows).collect())  # nothing to judge by
    assert lm.classify(no_rows, trusted).collect() == []


def running(text, order):
    """n-grams of every event of a text, over word ends."""
    s = b"\n " + b"".join(w + b" " for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()))
    return [s[max(0, i - order + 1):i + 1] for i in range(2, len(s))]


class Running(Brute):
    def __init__(self, texts, order):
        renamed = lambda g: g.replace(b" ", b"\r").replace(b"\n", b" ")  # Brute's begin is the space
        self.renamed = renamed
        super().__init__(texts, order)

    def perplexity(self, text, order):
        costs = [-math.log(self.p(self.renamed(g))) for g in running(text, order)]
        return math.exp(sum(costs) / len(costs)) if costs else None


def test_running_context_matches_the_definition(corpus, monkeypatch):
    df, rows = corpus
    trusted = df.where("doc_id < 300")
    got = lm.classify(df, trusted, order=7, quantile=0.9, across=True).collect()
    monkeypatch.setitem(globals(), "events", lambda t, n: [
        g.replace(b" ", b"\r").replace(b"\n", b" ") for g in running(t, n)])
    brute = Running([t for i, t, _ in rows if i < 300], 7)
    assert len(got) == len(rows)
    for r in got:
        assert r.out.perplexity == pytest.approx(brute.perplexity(r.row.text, 7), rel=1e-4)


def test_word_order_and_repetition_cost(spark, tmp_path):
    """Shuffled good words and a repeated word have a higher perplexity than good text
    (and the repeated word than the word alone); the query's own model is used."""
    from creditscope.llm import queries

    rng = random.Random(3)
    follow = {a: b for a, b in zip("the old man walked slowly to his small house near a river".split(),
                                   "old man walked slowly to his small house near a river the".split())}
    words = list(follow)
    def good(n):
        out = [rng.choice(words)]
        while len(out) < n:
            out.append(follow[out[-1]] if rng.random() < 0.9 else rng.choice(words))
        return out
    rows = [(i, " ".join(good(30))) for i in range(200)]
    kept = good(40)
    rows += [(1000, " ".join(kept)), (1001, " ".join(rng.sample(kept, len(kept)))),
             (1002, "river " * 40), (1003, "river")]
    spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.perplexity for r in queries.QUERIES["op5_quality_lm"](spark, str(tmp_path)).collect()}
    assert got[1001] > 1.2 * got[1000]
    assert got[1002] > 1.2 * got[1000]
    assert got[1002] > got[1003]


def test_trusted_documents_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "b", 7, 8)], "doc_id long, text string, trusted_id long, `a.b` long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in lm.trusted_documents(docs, labels).collect()] == [(1, "a", 5, 6)]


def test_grams_across_words_by_their_definition():
    rng = random.Random(5)
    cases = [["a"], ["", None], [], ["\x0ba b\t\n", None, "c"]]
    cases += [[None if rng.random() < 0.1 else "".join(rng.choices(" \n\x0bab\x00ü", k=rng.randint(0, 9)))
               for _ in range(rng.randint(1, 5))] for _ in range(200)]
    for texts in cases:
        for order in (1, 2, 5, 7):
            want = Counter()
            for text in texts:
                words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
                s = b"\n " + b"".join(w + b" " for w in words)
                want.update(int.from_bytes(b"\1" + s[max(0, i - order + 1):i + 1], "big") for i in range(2, len(s)))
            keys, times = lm._distinct(pa.array(texts, pa.string()), order, True)
            assert dict(zip(keys.tolist(), times.tolist())) == want, (texts, order)


def test_grams_are_built_on_bytes():
    """Eight bytes for a symbol's n-gram, a few arrays of them: not an array for each step."""
    rng = random.Random(6)
    texts = pa.array([" ".join(rng.choices(["alpha", "be", "gamma", "x"], k=500)) for _ in range(200)])
    size = sum(len(t) for t in texts.to_pylist())
    tracemalloc.start()
    try:
        lm._distinct(texts, 7, True)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 * size, peak / size


@pytest.mark.parametrize("together", [1_000_000, 1])
def test_blocks_share_the_lookups_of_a_shard(monkeypatch, together):
    """n-grams that several blocks ask of a shard are looked up once; each block gets its own costs."""
    monkeypatch.setattr(lm, "ASKED", together, raising=False)
    texts = pa.array(["the old man walked slowly", "to his small house near a river", None, "river river"])
    counted = list(lm._add_up(lm._count(iter([pa.record_batch([texts, pa.array([0, 0, 0, 1])], names=["text", "fold"])]),
                                        7, True, 1)))
    model = lm.Model(None, 1, {m: {s: (0.5, 0.7, 0.9) for s in range(3, 8)} for m in range(lm.ALL, lm.FOLDS)},
                     {m: ([1 / 256] * 256, [1 / 256] * 65536) for m in range(lm.ALL, lm.FOLDS)}, 7, True)
    model.short = {m: tuple(map(lm.np.array, short)) for m, short in model.short.items()}
    whole = lm._distinct(texts, 7, True)[0]
    asked = {1: (lm.ALL, whole), 2: (lm.ALL, whole[::2]), 3: (0, whole), 4: (lm.ALL, whole[:0]), 5: (lm.ALL, whole)}
    rows = [(0, 0, None, None, counted[0].column(1)[0].as_py(), counted[0].column(2)[0].as_py())]
    rows += [(0, 0, block, fold, lm._pack_sorted(keys), None) for block, (fold, keys) in asked.items()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
        pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
        names=["shard", "copy", "block", "fold", "grams", "counts"])
    looked_up, costs = [], lm._Shard.costs
    monkeypatch.setattr(lm._Shard, "costs", lambda self, gram: looked_up.append(len(gram)) or costs(self, gram))
    got = {b: lm._unpack(c) for out in lm._answer(iter([batch]), model) for b, _, c in zip(*(c.to_pylist() for c in out.columns))}
    if together > 1:
        assert looked_up == [len(whole), len(whole)]  # once per model, not once per block
    table = lm._unpack_sorted(rows[0][4]), lm._unpack(rows[0][5]).reshape(lm.FOLDS, -1)
    for block, (fold, keys) in asked.items():
        n = dict(lm._models(table[1]))[fold]
        shard = lm._Shard(table[0], n, 7, model.begin, model.discounts[fold], model.short[fold])
        assert got[block].tolist() == costs(shard, keys).tolist()


def test_copies_of_a_block_wait_for_all_its_slices(spark):
    """Blocks of the same texts in the same order share a number; each row still gets its own result."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(words, k=1500)), "en") for i in range(700)]
    assert sum(len(t) for _, t, _ in rows) > 2 * lm.textscan.SLICE_BYTES  # several slices a block
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    copies = one
    for k in (1, 2):
        copies = copies.unionByName(one.withColumn("doc_id", lm.F.col("doc_id") + 1000 * k))
    trusted = one.where("doc_id < 50")
    got = {r.doc_id: r.out for r in lm.classify(copies, trusted, order=7, across=True, keep=["doc_id"]).select("row.*", "out").collect()}
    assert len(got) == 3 * len(rows)
    want = {r.doc_id: r.out for r in lm.classify(one, trusted, order=7, across=True, keep=["doc_id"]).select("row.*", "out").collect()}
    assert all(got[i + 1000 * k] == want[i] for i in want for k in range(3))


def test_texts_are_summed_in_pieces(monkeypatch):
    """Means by their definition; arrays of a piece of the texts at a time, whatever their number."""
    rng = random.Random(8)
    for n in (0, 1, 127, 128, 129, 300):
        texts = [rng.choice([None, "", " \t", "x", "".join(rng.choices(" ab\nü", k=rng.randint(0, 30)))]) for _ in range(n)]
        array, built, grams = pa.array(["front", *texts], pa.string()).slice(1), [], lm.text_grams
        found = lm._distinct(array, 7, True)[0]
        monkeypatch.setattr(lm, "text_grams", lambda t, order: built.append(len(t)) or grams(t, order))
        got = lm._log_perplexities(array, 7, True, found, found % 1000)
        monkeypatch.setattr(lm, "text_grams", grams)
        assert sum(built) == n == len(got) and max(built, default=0) <= 128
        for text, value in zip(texts, got):
            keys = [int.from_bytes(b"\1" + g, "big") % 1000 for g in running(text, 7)]
            assert (value == sum(keys) / len(keys) / lm.COST_SCALE) if keys else math.isnan(value)
