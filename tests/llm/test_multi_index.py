import numpy as np

from creditscope.llm import multi_index
from creditscope.llm.queries import QUERIES
from tests.conftest import SF01

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, queries, k):
    """Best (score, -id) lists by query; every distinct (id, vector) is a candidate."""
    rows = list({(i, tuple(v)) for i, v in rows})
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for q, v in queries:
        score = x @ np.array(v)
        order = [j for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / max(1, len(w)) for q, w in want.items()])


def test_traversal_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, sizes = rng.random(7), rng.random(5), rng.integers(0, 4, 35)
    cells = multi_index.traversal(a, b, sizes, 40)
    total = (a[:, None] + b).ravel()
    want = [c for c in np.argsort(total) if sizes[c]]
    assert cells.tolist() == want[:len(cells)] and sizes[cells].sum() >= 40 > sizes[cells[:-1]].sum()
    assert len(multi_index.traversal(a, b, sizes, 10**6)) == (sizes > 0).sum()


def test_recall_on_hard_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_DEPTH", 1)
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 300)
    monkeypatch.setattr(multi_index, "SAMPLE", 1500)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 3
    for x in (rng.normal(size=(4000, 16)), centres[rng.integers(0, 60, 4000)] + rng.normal(size=(4000, 16))):
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        df = spark.createDataFrame(rows, SCHEMA)
        got, want = found(multi_index.nearest(df, df.where("vec_id % 20 = 0"), 20)), brute(rows, rows[::20], 20)
        assert got.keys() == want.keys() and recall(got, want) >= 0.9
        for q, list_ in got.items():
            assert len(list_) == 20 and all(abs(s - x[i] @ x[q]) < 1e-9 for i, s in list_)


def test_index_scans_a_share(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_DEPTH", 1)
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(100, 16)) * 5)[rng.integers(0, 100, 5000)] + rng.normal(size=(5000, 16)) * 0.3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index, table = multi_index.build(df, 20)
    assert table.count() == 5000 and index.sizes.sum() == 5000 and index.share < 0.1


def test_copies_share_an_entry(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "SHARD_ROWS", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8))
    x[100:400] = x[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(120, x[5].tolist()), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    asking = [(i, v) for i, v in rows[:900] if i % 20 == 0]
    asking = [(i, min(w for j, w in rows if j == i)) for i, _ in asking]
    got = found(multi_index.nearest(df, df.where("vec_id % 20 = 0"), 20))
    want = brute(rows, asking, 20)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, []),
            (7, [0.25]), (8, [0.5, 0.5]), (9, [0.0, 0.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.3]), (40, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as cell", "2 as shard", "3 as score", "'x' as v", "4 as id")
    got = found(multi_index.nearest(df, df.where("vec_id % 20 = 0"), 20))
    good = [(i, (v + [0.0])[:2]) for i, v in rows if i in (0, 1, 7, 8, 20)]
    want = brute(good, [g for g in good if g[0] % 20 == 0], 20)
    assert {q: [i for i, _ in g] for q, g in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert multi_index.nearest(df.limit(0), df.limit(0)).collect() == []
    one = df.where("vec_id = 0")
    assert multi_index.nearest(one, one).collect() == []


def test_query_recall(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LEAST_DEPTH", 1)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect() if r.embedding]
    got = found(QUERIES["op12_multi_index"](spark, SF01))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
