"""Model parity: logit against a NumPy Newton solver; KMeans on separable blobs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditscope.plans import decision, models, state


def newton_l2_logit(X, y, C=1.0, iters=50):
    n, p = X.shape
    Xb = np.hstack([np.ones((n, 1)), X])
    w = np.zeros(p + 1)
    reg = np.eye(p + 1) / C
    reg[0, 0] = 0.0
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (mu - y) + reg @ w
        H = (Xb * (mu * (1 - mu))[:, None]).T @ Xb + reg
        w -= np.linalg.solve(H, g)
    return w[1:]


def test_logit_matches_newton(spark, tables001):
    cur = state.account_current(tables001)
    out = {r.driver: r for r in models.delinquency_drivers(cur).collect()}
    pdf = models.driver_frame(cur).toPandas()
    X = pdf[list(models.DRIVERS)].to_numpy(float)
    X = (X - X.mean(0)) / np.where(X.std(0) == 0, 1, X.std(0))
    w = newton_l2_logit(X, pdf["label"].to_numpy(float))
    for d, c in zip(models.DRIVERS, w):
        assert out[d].coef_per_sd == pytest.approx(round(c, 3), abs=0.0015)
        assert out[d].odds_ratio_per_sd == pytest.approx(round(math.exp(c), 2), abs=0.011)


def test_kmeans_separable_blobs(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0.1, 800, 90000, 200, 0], [0.5, 700, 60000, 100, 0],
                        [0.7, 640, 40000, 30, 30], [1.0, 560, 20000, 10, 120]])
    rows = []
    for j, c in enumerate(centres):
        for i in range(50):
            x = c * (1 + rng.normal(0, 0.01, 5))
            rows.append((j * 1000 + i, float(x[0]), int(x[1]), float(x[2]), int(x[3]), int(c[4]), j))
    df = spark.createDataFrame(rows, "account_id long, utilization double, fico_origination int, "
                                     "annual_income double, credit_history_months int, days_past_due int, truth int")
    df = df.withColumn("annual_income", F.col("annual_income").cast("decimal(12,2)"))
    seg = models.behavior_segments(df, k=4, restarts=3).collect()
    assert sorted(r.accounts for r in seg) == [50, 50, 50, 50]
    assert [r.segment for r in seg][0] == "Segment A - Lowest risk"


def test_more_segments_than_names(spark, tables001):
    cur = state.account_current(tables001)
    names = [r.segment for r in models.behavior_segments(cur, k=6, restarts=2).orderBy("segment").collect()]
    assert names[:4] == list(models.CFG.segment_names) and names[4:] == ["Segment E", "Segment F"]


def test_restarts_together_match_separate_fits(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    points = spark.createDataFrame([[float(v) for v in r] for r in x], "z0 double, z1 double")

    def cost(centres):
        return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()

    together = models.fit_kmeans(points, 4, range(6))
    apart = [models.fit_kmeans(points, 4, [s]) for s in range(6)]
    assert cost(together) == pytest.approx(min(cost(c) for c in apart))
    assert cost(together) <= 60 * 4 * 2 * 0.3 ** 2 * 1.3


def test_a_value_shared_by_most_rows_does_not_fill_the_starts(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.1, size=(40, 2)) for c in ((0, 0), (8, 0), (0, 8))])
    single = spark.createDataFrame([[float(v) for v in r] for r in x], "z0 double, z1 double")
    common = tuple(single.orderBy(F.xxhash64("z0", "z1")).first())
    points = single.unionByName(spark.createDataFrame([common] * 2500, "z0 double, z1 double"))
    centres = models.fit_kmeans(points, 3, range(3))
    assert ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum() < 120 * 2 * 0.1 ** 2 * 3


def test_logit_finds_planted_coefficients(spark):
    rng = np.random.default_rng(9)
    n = 6000
    util, thin, fico = rng.uniform(0, 1.5, n), rng.random(n) < 0.3, rng.normal(690, 50, n).round()
    income, age = np.exp(rng.normal(11, 0.5, n)), rng.integers(20, 80, n)
    z = lambda v: (v - v.mean()) / v.std()
    planted = {"utilization": 1.2, "thin_file": 0.4, "fico_origination": -0.8, "log_income": -0.3, "age": 0.0}
    line = -0.5 + sum(w * z(v.astype(float)) for w, v in zip(planted.values(), (util, thin, fico, np.log(income), age)))
    late = rng.random(n) < 1 / (1 + np.exp(-line))
    rows = [(float(u), bool(t), int(f), float(i), int(a), 60 if d else 0)
            for u, t, f, i, a, d in zip(util, thin, fico, income, age, late)]
    cur = spark.createDataFrame(rows, "utilization double, thin_file boolean, fico_origination int, annual_income double, "
                                      "age int, days_past_due int")
    got = {r.driver: r.coef_per_sd for r in models.delinquency_drivers(cur).collect()}
    for driver, w in planted.items():
        assert got[driver] == pytest.approx(w, abs=0.12)
    at = {"intercept": 0.0} | {d: float(got[d]) for d in planted}
    slopes = {r.term: r.gradient for r in models.driver_gradient(cur, at).collect()}
    assert max(abs(slopes[d]) for d in planted) < max(abs(g) for g in {
        r.term: r.gradient for r in models.driver_gradient(cur).collect()}.values())


def test_headline_with_driver(spark, tables001):
    cur = state.account_current(tables001)
    drivers = models.delinquency_drivers(cur)
    row = decision.headline_findings(tables001, cur, drivers=drivers).first()
    top = drivers.orderBy(F.col("odds_ratio_per_sd").desc()).first()
    assert row.top_driver == top.driver and row.top_driver_odds_ratio == top.odds_ratio_per_sd
    assert list(row.asDict()) == list(decision.HEADLINE_KEYS) and len(row) == 22


def test_drivers_with_one_label_or_no_rows(spark, tables001):
    cur = state.account_current(tables001)
    for rows in (cur.withColumn("days_past_due", F.lit(90)), cur.withColumn("days_past_due", F.lit(0)), cur.limit(0)):
        assert {(r.coef_per_sd, r.odds_ratio_per_sd) for r in models.delinquency_drivers(rows).collect()} == {(0.0, 1.0)}


def test_newton_halves_steps_on_separable_rows(spark):
    # Nearly separable with a weak penalty: full Newton steps overshoot.
    rows = [(1.9 if i % 2 else 0.1, False, 700, 50000.0, 40 + i % 3, 60 if i % 2 else 0) for i in range(60)]
    cur = spark.createDataFrame(rows + [(1.9, True, 690, 50000.0, 41, 0)],
                                "utilization double, thin_file boolean, fico_origination int, annual_income double, age int, days_past_due int")
    z = models.standardize(models.driver_frame(cur), list(models.DRIVERS))
    beta = models.fit_drivers(z, c_inverse_reg=1000.0)
    loss, gradient, *_ = models._newton_sums(z, beta)
    assert np.abs(gradient[1:] + beta[1:] / 1000).max() < 1e-6 and abs(gradient[0]) < 1e-6


def plain_lloyd(x, centres, steps):
    for _ in range(steps):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[own == i].mean(0) if (own == i).any() else c for i, c in enumerate(centres)])
    own = ((x[:, None] - centres) ** 2).sum(2)
    return centres, own.min(1).sum(), np.bincount(own.argmin(1), minlength=len(centres))


def test_split_rounds_are_plain_lloyd(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 1.0, size=(150, 2)) for c in ((0, 0), (3, 0), (0, 4), (4, 4))] + [np.zeros((50, 2))])
    points = spark.createDataFrame([[float(v) for v in r] for r in x], "z0 double, z1 double")
    weighted = models._weighted(points, 2)
    starts = {r: x[rng.permutation(len(x))[:4]] for r in range(3)}
    monkeypatch.setattr(models, "SLACK", 2)
    seen, split = [], models._split
    monkeypatch.setattr(models, "_split", lambda w, open_, k, width: (seen.append((split(w, open_, k, width), len(open_))), seen[-1][0])[1])
    for steps in (0, 4, 12):
        got = models.lloyd(weighted, starts, max_iter=steps, tol=0.0)
        for r, c in starts.items():
            centres, cost, sizes = plain_lloyd(x, c, steps)
            assert np.allclose(got[r].centres, centres) and got[r].cost == pytest.approx(cost)
            assert got[r].sizes.tolist() == sizes.tolist()
    # Rows whose cluster is certain are left out of the rounds after a split.
    assert seen and any(rest.count() < 0.7 * n * weighted.count() for rest, n in seen)
    weighted.unpersist()
