"""Behaviour segments (KMeans) and delinquency drivers (logistic regression), Q-16/Q-17.

Feature preparation is DataFrame work: exact medians for the fill (counted values
in ranges; never collected), population mean / std from one aggregate used as scalar
subqueries, z-scores as column arithmetic.  KMeans runs all restarts in one aggregate per
round, the logit one aggregate per Newton step.  Only sums and fitted parameters (k
centres, six coefficients) come to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.functions.exprs import half_up, rate, ratio_half_up, round_half_up
from creditscope.operators.ranking import exact_medians
from creditscope.plans.kpis import count_if
from creditscope.session import freeze

CFG = PortfolioConfig()

# Feature and driver names of the published results.
SEGMENT_FEATURES = ("utilization", "fico_origination", "annual_income", "credit_history_months",
                    "days_past_due")
DRIVERS = ("utilization", "thin_file", "fico_origination", "log_income", "age")

# Reference centres in z-score space (order of SEGMENT_FEATURES),
# used by ``segment_assign`` to score accounts against a saved segmentation.
REFERENCE_CENTRES = (
    (-0.5, 1.0, 0.5, 0.3, -0.4),
    (-0.2, 0.0, -0.2, 1.2, -0.3),
    (0.0, -0.5, -0.3, -0.6, -0.2),
    (2.0, -1.0, -0.5, -0.2, 2.5),
)


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population std of each column (std 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mean_{c}"), F.stddev_pop(c).alias(f"_sd_{c}"),
                 F.count(c).alias(f"_n_{c}")]
    return df.agg(*aggs)


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-score columns ``z_<c>`` using population moments.  The moments are
    scalar subqueries over one aggregate (Catalyst merges them into one)."""
    m = moments(df, cols)
    out = df
    for c in cols:
        sd = m.select(F.when(F.col(f"_sd_{c}").isNull() | (F.col(f"_sd_{c}") == 0), F.lit(1.0))
                      .otherwise(F.col(f"_sd_{c}"))).scalar()
        out = out.withColumn(f"z_{c}", (F.col(c) - m.select(f"_mean_{c}").scalar()) / sd)
    return out


def segment_features(cur: DataFrame) -> DataFrame:
    """Median-filled, standardised segmentation features, one row per account."""
    # Several driver actions (medians, moments, fits) read this
    # narrow account-level frame: checkpoint it once instead of re-deriving the
    # current state for each of them.
    base = freeze(cur.select("account_id", "utilization", "fico_origination", "annual_income",
                             "credit_history_months", "days_past_due",
                             (F.col("days_past_due") >= CFG.delinquent_dpd).alias("delinquent"),
                             *[F.col(c).cast("double").alias(f"f_{c}") for c in SEGMENT_FEATURES]))
    med = exact_medians(base, [f"f_{c}" for c in SEGMENT_FEATURES])
    filled = base
    for c in SEGMENT_FEATURES:
        filled = filled.withColumn(f"f_{c}", F.coalesce(F.col(f"f_{c}"), med.select(f"f_{c}").scalar()))
    return standardize(filled, [f"f_{c}" for c in SEGMENT_FEATURES])


def _profile(assigned: DataFrame) -> DataFrame:
    g = assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("utilization").alias("_us"), F.count("utilization").alias("_un"),
        F.sum("fico_origination").alias("_fs"), F.count("fico_origination").alias("_fn"),
        (F.sum("annual_income") * 100).cast("decimal(38,0)").alias("_is"),
        (F.count("annual_income") * 100).alias("_in"),
        F.sum("credit_history_months").alias("_hs"), F.count("credit_history_months").alias("_hn"),
        count_if(F.col("delinquent")).alias("_del"))
    return g.select("cluster", "accounts",
                    round_half_up(F.col("_us") / F.col("_un") * F.lit(100.0), 1).alias("avg_utilization"),
                    half_up("_fs", "_fn", 0).alias("avg_fico"),
                    ratio_half_up(F.col("_is"), F.col("_in"), 0).alias("avg_income"),
                    half_up("_hs", "_hn", 0).alias("avg_history_months"),
                    rate("_del", "accounts", 2).alias("delinquency_rate"))


def _name_segments(profile: DataFrame, names: Sequence[str]) -> DataFrame:
    # k rows: the unpartitioned window only ever sees the profile.
    w = Window.orderBy(F.col("delinquency_rate").asc_nulls_last(), F.col("accounts").desc(), F.col("cluster"))
    idx = F.row_number().over(w)
    named = F.try_element_at(F.array(*[F.lit(n) for n in names]), idx)
    # More segments than published names: lettered on.
    label = F.coalesce(named, F.concat(F.lit("Segment "), F.char(F.lit(ord("A") - 1) + idx)))
    return profile.withColumn("segment", label).orderBy("delinquency_rate", "cluster")


def assign_nearest(z: DataFrame, centres: Sequence[Sequence[float]], cols: Sequence[str]) -> DataFrame:
    """Cluster = index of the nearest centre by squared distance (ties: lowest index)."""
    dist: list[Column] = []
    for centre in centres:
        d = None
        for c, v in zip(cols, centre):
            term = (F.col(f"z_{c}") - F.lit(float(v))) * (F.col(f"z_{c}") - F.lit(float(v)))
            d = term if d is None else d + term
        dist.append(d)
    best = F.lit(len(centres) - 1)
    for i in range(len(centres) - 2, -1, -1):
        cond = None
        for j in range(i + 1, len(centres)):
            c = dist[i] <= dist[j]
            cond = c if cond is None else cond & c
        best = F.when(cond, F.lit(i)).otherwise(best)
    return z.withColumn("cluster", best.cast("int"))


def segment_assign(cur: DataFrame, centres=REFERENCE_CENTRES, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Profile of accounts assigned to literal centres (a saved segmentation)."""
    z = segment_features(cur)
    assigned = assign_nearest(z, centres, [f"f_{c}" for c in SEGMENT_FEATURES])
    return _name_segments(_profile(assigned), cfg.segment_names)


def segments_step(cur: DataFrame, centres=REFERENCE_CENTRES) -> DataFrame:
    """One round of the segmentation from literal centres: per cluster its accounts,
    its cost and its updated centre (6 dp)."""
    cols = [f"f_{c}" for c in SEGMENT_FEATURES]
    assigned = assign_nearest(segment_features(cur), centres, cols)
    at = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in centres])
    own = F.element_at(at, F.col("cluster") + 1)
    cost = sum((F.col(f"z_{c}") - own[j]) * (F.col(f"z_{c}") - own[j]) for j, c in enumerate(cols))
    return assigned.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("accounts"), round_half_up(F.sum(cost), 6).alias("cost"),
        *[round_half_up(F.avg(f"z_f_{c}"), 6).alias(c) for c in SEGMENT_FEATURES])


def _centres_column(centres: dict[int, np.ndarray]) -> str:
    """SQL of an array of structs (r, c<i>_<j>), one per restart.  As data of a generated
    or looked-up column, not as literals in the arithmetic, new centres leave the
    compiled plan as it is."""
    return "array(" + ", ".join(
        f"struct({r} as r, " + ", ".join(f"{v!r}D as c{i}_{j}" for i, row in enumerate(c.tolist()) for j, v in enumerate(row)) + ")"
        for r, c in centres.items()) + ")"


def _with_distances(rows: DataFrame, k: int, width: int) -> DataFrame:
    """Adds d<i> (squared distance to centre i of column ``c``), d (the least) and i (its
    index, the lowest of equals)."""
    square = lambda i, j: f"(z{j} - c.c{i}_{j}) * (z{j} - c.c{i}_{j})"
    # Generated columns are computed once: as plain ones the optimizer would write each
    # distance out wherever it is compared.
    each = ", ".join(" + ".join(square(i, j) for j in range(width)) + f" as d{i}" for i in range(k))
    rows = rows.selectExpr("*", f"inline(array(struct({each})))")
    least = f"least({', '.join(f'd{i}' for i in range(k))})" if k > 1 else "d0"
    rows = rows.selectExpr("*", f"inline(array(struct({least} as d)))")
    which = "case " + " ".join(f"when d{i} = d then {i}" for i in range(k)) + " end"
    return rows.selectExpr("*", f"inline(array(struct({which} as i)))")


def _cluster_sums(near: DataFrame, width: int) -> DataFrame:
    return near.groupBy("r", "i").agg(F.sum("w").alias("m"), F.sum(F.col("d") * F.col("w")).alias("d"),
                                      *[F.sum(F.col(f"z{j}") * F.col("w")).alias(f"s{j}") for j in range(width)])


def _starting_centres(weighted: DataFrame, k: int, seeds: Sequence[int], width: int, passes: int = 2) -> dict[int, np.ndarray]:
    """k-means|| of every seed over all rows: a first point, then ``passes`` times 2k more,
    drawn with probability proportional to rows times squared distance to those
    before (the first in an exponential race); the candidates, weighted by the rows nearest to them, are
    clustered on the driver.  ``passes`` + 2 aggregates whatever k is."""
    more = 2 * k
    chosen = {s: np.zeros((0, width)) for s in seeds}
    for step in range(passes + 1):
        size = 1 + passes * more
        rows, rate = weighted, "cast(w as double)"
        if step:
            # Filled up with repeated candidates, so that every pass runs one compiled plan.
            full = {s: np.resize(c, (size, width)) for s, c in chosen.items()}
            rows = _with_distances(weighted.selectExpr("*", f"explode({_centres_column(full)}) as c"), size, width)
            rows, rate = rows.selectExpr(*[f"z{j}" for j in range(width)], "w", "d", "c.r as seed"), "w * d"
        else:
            rows = weighted.selectExpr("*", f"explode(array({', '.join(map(str, seeds))})) as seed")
        point = ", ".join(f"z{j}" for j in range(width))
        u = f"(pmod(xxhash64({point}, seed, {step}), {1 << 52}) + 1) / {float((1 << 52) + 1)}D"
        race = rows.selectExpr("seed", *[f"z{j}" for j in range(width)], f"case when {rate} > 0 then -ln({u}) / ({rate}) end as at").where("at is not null")
        first = race.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("at", *[f"z{j}" for j in range(width)])))
        got = first.where(F.col("n") <= (more if step else 1)).collect()
        for s in seeds:
            drawn = [[r[f"z{j}"] for j in range(width)] for r in sorted(got, key=lambda r: r["n"]) if r["seed"] == s]
            chosen[s] = np.concatenate([chosen[s], np.array(drawn).reshape(-1, width)])
    full = {s: np.resize(c, (size, width)) for s, c in chosen.items()}
    near = _with_distances(weighted.selectExpr("*", f"explode({_centres_column(full)}) as c"), size, width)
    counts = near.groupBy("c.r", "i").agg(F.sum("w").alias("m")).collect()
    out = {}
    for s in seeds:
        weight = np.zeros(size)
        for row in counts:
            if row["r"] == s:
                weight[row["i"]] = row["m"]
        out[s] = _clustered(chosen[s], weight[:len(chosen[s])], k, np.random.default_rng(s))
    return out


def _clustered(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ and Lloyd rounds over the few candidates of one seed."""
    centres = x[[rng.choice(len(x), p=w / w.sum())]]
    while len(centres) < k:
        apart = w * ((x[:, None] - centres) ** 2).sum(2).min(1)
        # Fewer distinct points than centres: some are equal.
        centres = np.vstack([centres, x[rng.choice(len(x), p=apart / apart.sum())] if apart.sum() > 0 else x[0]])
    for _ in range(50):
        own = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        mass = np.bincount(own, w, k)
        moved = np.stack([np.bincount(own, w * x[:, j], k) for j in range(x.shape[1])], axis=1)
        moved = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres[np.lexsort(centres.T[::-1])]


class _Restart:
    """A restart's centres, and what is known of the rows that cannot change clusters."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.moved, self.cost, self.sizes = centres, np.inf, np.inf, None
        self.since, self.slack, self.settled = None, 0.0, None
        self.done, self.mean, self.before = False, None, np.inf

    def near_enough(self) -> bool:
        """Whether no centre left its place at the split by more than the slack."""
        return self.settled is not None and np.sqrt(((self.centres - self.since) ** 2).sum(1)).max() <= self.slack

    def step(self, rows: list, tol: float, last: bool, relax: float) -> bool:
        """Takes the sums of a round; says whether the restart is done.  With ``relax`` above
        1 the centres go beyond the means, and back to them if that raised the cost."""
        k, width = self.centres.shape
        total = np.zeros((k, width + 1)) if self.settled is None else self.settled[:, :-1].copy()
        self.cost = 0.0 if self.settled is None else self._settled_cost()
        self.costs = np.zeros(k)
        for g in rows:
            total[g["i"]] += [g["m"], *[g[f"s{j}"] for j in range(width)]]
            self.cost += g["d"]
            self.costs[g["i"]] += g["d"]
        self.sizes = total[:, 0]
        moved = np.where(total[:, :1] > 0, total[:, 1:] / np.maximum(total[:, :1], 1), self.centres)
        self.moved = float(np.sqrt(((moved - self.centres) ** 2).sum(1)).max())
        if last or ((moved - self.centres) ** 2).sum() <= tol:
            return True  # the cost belongs to these centres
        if relax == 1 or self.cost > self.before and self.mean is not None:
            self.centres, self.mean, self.before = moved if relax == 1 else self.mean, None, np.inf
        else:
            self.mean, self.before = moved, self.cost
            self.centres = self.centres + relax * (moved - self.centres)
        return False

    def _settled_cost(self) -> float:
        mass, sums, squares = self.settled[:, 0], self.settled[:, 1:-1], self.settled[:, -1]
        return float((squares - 2 * (sums * self.centres).sum(1) + mass * (self.centres ** 2).sum(1)).sum())


def _split(weighted: DataFrame, restarts: dict[int, _Restart], k: int, width: int) -> DataFrame:
    """The rows that may still change clusters while no centre moves farther than the
    slack (Hamerly's bounds: the second nearest centre is not beyond the nearest by
    more than twice the slack), written once; the sums of all others go to the restarts."""
    for x in restarts.values():
        x.since, x.slack = x.centres, SLACK * x.moved
    slack = "element_at(map(" + ", ".join(f"{r}, {2 * x.slack!r}D" for r, x in restarts.items()) + "), c.r)"
    near = _with_distances(weighted.selectExpr(
        "*", f"explode({_centres_column({r: x.centres for r, x in restarts.items()})}) as c"), k, width)
    second = "least(" + ", ".join(f"if(i = {i}, double('inf'), d{i})" for i in range(k)) + ", double('inf'))"
    near = near.selectExpr("c.r as r", "i", "d", "w", *[f"z{j}" for j in range(width)],
                           f"sqrt({second}) - sqrt(d) <= {slack} as open")
    rest = freeze(near.where("open").select("r", "w", *[f"z{j}" for j in range(width)]))
    square = " + ".join(f"z{j} * z{j}" for j in range(width))
    sums = near.where("not open").groupBy("r", "i").agg(
        F.sum("w").alias("m"), *[F.sum(F.col(f"z{j}") * F.col("w")).alias(f"s{j}") for j in range(width)],
        F.sum(F.expr(f"({square}) * w")).alias("q")).collect()
    for r, x in restarts.items():
        x.settled = np.zeros((k, width + 2))
        for g in sums:
            if g["r"] == r:
                x.settled[g["i"]] = [g["m"], *[g[f"s{j}"] for j in range(width)], g["q"]]
    return rest


#: Rows are split for centres that move this many times as far as in the last round.
SLACK = 8
#: How far centres go towards and beyond their means: halves the rounds of slow restarts.
RELAX = 1.6
#: Full rounds before rows are split: centres still move far.
FULL_ROUNDS = 3


def lloyd(weighted: DataFrame, starts: dict[int, np.ndarray], max_iter: int = 300, tol: float = 1e-4,
          relax: float = 1.0) -> dict[int, _Restart]:
    """Lloyd rounds of all restarts together over distinct points (z0, z1, ... and w: rows):
    one aggregate per round.  From some round on, rows whose nearest centre is certain
    are not read again until a centre has left the bound that made it certain.  A
    restart is done when its centres' squared shifts sum to at most ``tol``."""
    every = {r: _Restart(c) for r, c in starts.items()}
    k, width = next(iter(every.values())).centres.shape
    rest = None
    for round_ in range(max_iter + 1):
        open_ = {r: x for r, x in every.items() if not x.done}
        if not open_:
            break
        if round_ >= FULL_ROUNDS and not all(x.near_enough() for x in open_.values()):
            rest = _split(weighted, open_, k, width)
        column = _centres_column({r: x.centres for r, x in open_.items()})
        if rest is None:
            rows = weighted.selectExpr("*", f"explode({column}) as c")
        else:
            # A closed restart's rows find no centres.
            place = "map(" + ", ".join(f"{r}, {n}" for n, r in enumerate(open_)) + ")"
            rows = rest.selectExpr("*", f"get({column}, element_at({place}, r)) as c").drop("r").where("c is not null")
        near = _with_distances(rows, k, width).withColumn("r", F.col("c.r"))
        got = _cluster_sums(near, width).collect()
        for r, x in open_.items():
            x.done = x.step([g for g in got if g["r"] == r], tol, round_ == max_iter, relax)
    return every


def _weighted(points: DataFrame, width: int) -> DataFrame:
    """Distinct points z0, z1, ... with their numbers of rows ``w``."""
    return points.groupBy(*[f"z{j}" for j in range(width)]).agg(F.count(F.lit(1)).alias("w")).persist(
        StorageLevel.MEMORY_AND_DISK)


def fit_kmeans(points: DataFrame, k: int, seeds: Sequence[int], max_iter: int = 300, tol: float = 1e-4) -> np.ndarray:
    """The best of seeded KMeans restarts over ``points`` (columns z0, z1, ...): k-means||
    starts and Lloyd rounds, all over all rows; every restart stops on its own
    tolerance; returns the centres with the least cost."""
    width = len(points.columns)
    weighted = _weighted(points, width)
    every = lloyd(weighted, _starting_centres(weighted, k, list(seeds), width), max_iter, tol, RELAX)
    weighted.unpersist()
    return every[min(every, key=lambda s: (every[s].cost, s))].centres


def _points(z: DataFrame) -> DataFrame:
    return z.select(*[F.col(f"z_f_{c}").alias(f"z{j}") for j, c in enumerate(SEGMENT_FEATURES)])


def behavior_segments(cur: DataFrame, k: int | None = None, restarts: int | None = None,
                      cfg: PortfolioConfig = CFG) -> DataFrame:
    """KMeans on the standardised features with several seeded restarts (the
    lowest cost wins), then per-cluster profile named by delinquency."""
    z = freeze(segment_features(cur))
    best = fit_kmeans(_points(z), k or cfg.kmeans_k, [cfg.seed + i for i in range(restarts or cfg.kmeans_restarts)])
    return _name_segments(_profile(assign_nearest(z, best.tolist(), [f"f_{c}" for c in SEGMENT_FEATURES])), cfg.segment_names)


def segments_run(cur: DataFrame, steps: int = 6, cfg: PortfolioConfig = CFG) -> DataFrame:
    """One seeded run of a fixed number of rounds: from the k accounts that come first by a
    seeded digest, per cluster its accounts, its cost and its centre (6 dp)."""
    z = freeze(segment_features(cur))
    first = z.orderBy(F.md5(F.concat(F.col("account_id").cast("string"), F.lit(f"-{cfg.seed}"))), "account_id").limit(cfg.kmeans_k)
    start = np.array([list(r) for r in _points(first).collect()])
    width = len(SEGMENT_FEATURES)
    weighted = _weighted(_points(z), width)
    run = lloyd(weighted, {0: start}, max_iter=steps, tol=0.0)[0] if len(start) else None
    near = _with_distances(weighted.selectExpr("*", f"explode({_centres_column({0: run.centres})}) as c"), len(start), width)
    out = near.groupBy(F.col("i").alias("cluster")).agg(
        F.sum("w").alias("accounts"), round_half_up(F.sum(F.col("d") * F.col("w")), 6).alias("cost"), F.first("c").alias("c"))
    at = lambda j: F.element_at(F.array(*[F.col(f"c.c{i}_{j}") for i in range(len(start))]), F.col("cluster") + 1)
    return out.select("cluster", "accounts", "cost", *[round_half_up(at(j), 6).alias(c) for j, c in enumerate(SEGMENT_FEATURES)])


def driver_frame(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Model rows (no NULL in utilization, FICO, income, age) and raw drivers."""
    rows = cur.dropna(subset=["utilization", "fico_origination", "annual_income", "age"])
    return rows.select(
        F.least(F.greatest(F.col("utilization"), F.lit(0.0)), F.lit(2.0)).alias("utilization"),
        F.coalesce(F.col("thin_file"), F.lit(False)).cast("double").alias("thin_file"),
        F.col("fico_origination").cast("double").alias("fico_origination"),
        F.log(F.greatest(F.col("annual_income").cast("double"), F.lit(1.0))).alias("log_income"),
        F.col("age").cast("double").alias("age"),
        (F.col("days_past_due") >= cfg.delinquent_dpd).cast("double").alias("label"))


def driver_features(cur: DataFrame) -> DataFrame:
    """Per driver: rows used, mean and population std (6 dp) of the raw input."""
    m = moments(driver_frame(cur), DRIVERS)
    parts = ", ".join(f"'{d}', `_n_{d}`, `_mean_{d}`, `_sd_{d}`" for d in DRIVERS)
    long = m.selectExpr(f"stack({len(DRIVERS)}, {parts}) as (driver, n, mean, std)")
    return long.select("driver", F.col("n").cast("bigint").alias("n"),
                       round_half_up(F.col("mean"), 6).alias("mean"),
                       round_half_up(F.col("std"), 6).alias("std"))


def _newton_sums(z: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float, float]:
    """Loss, gradient and Hessian of the summed log loss at ``beta`` (intercept first),
    and the numbers of rows and of positive labels: one aggregate.

    The coefficients come as a generated one-row column, not as literals, so every step
    runs the same compiled plan."""
    terms = range(len(beta))
    given = ", ".join(f"{v!r}D as b{i}" for i, v in enumerate(beta.tolist()))
    x = ["1D", *[f"z_{d}" for d in DRIVERS]]
    at = z.select("*", F.expr(f"explode(array(struct({given}))) as b"))
    at = at.selectExpr("label", *[f"{c} as x{i}" for i, c in enumerate(x)], f"{' + '.join(f'b.b{i} * {x[i]}' for i in terms)} as line")
    at = at.selectExpr("*", "1 / (1 + exp(-line)) as p")
    cells = [(i, j) for i in terms for j in range(i + 1)]
    # The loss is log(1 + exp(line)) - label * line, without overflow.
    got = at.selectExpr(
        "sum(greatest(line, 0D) + log1p(exp(-abs(line))) - label * line) as loss", "count(*) as n", "sum(label) as late",
        *[f"sum((p - label) * x{i}) as g{i}" for i in terms],
        *[f"sum(p * (1 - p) * x{i} * x{j}) as h{i}_{j}" for i, j in cells]).first()
    hessian = np.zeros((len(beta), len(beta)))
    for i, j in cells:
        hessian[i, j] = hessian[j, i] = got[f"h{i}_{j}"] or 0.0
    gradient = np.array([got[f"g{i}"] or 0.0 for i in range(len(beta))])
    return got["loss"] or 0.0, gradient, hessian, got["n"], got["late"] or 0.0


def fit_drivers(z: DataFrame, c_inverse_reg: float = 1.0, tol: float = 1e-7, max_iter: int = 100) -> np.ndarray:
    """Intercept and coefficients by Newton steps (IRLS): per step one aggregate of the
    loss, the gradient and the 21 sums of the Hessian, and a 6 x 6 solve on the driver.  A step that
    raises the loss is halved.  With a single label value (or no rows) every
    coefficient is 0, as the penalty alone decides."""
    penalty = np.append(0.0, np.full(len(DRIVERS), 1.0 / c_inverse_reg))
    beta = np.zeros(len(DRIVERS) + 1)
    step, best = np.zeros_like(beta), np.inf
    for _ in range(max_iter):
        loss, gradient, hessian, n, late = _newton_sums(z, beta + step)
        if late in (0, n):
            return beta
        loss += (penalty * (beta + step) ** 2).sum() / 2
        if loss > best + 1e-9 * abs(best):
            step /= 2
            continue
        beta, best = beta + step, loss
        step = -np.linalg.solve(hessian + np.diag(penalty), gradient + penalty * beta)
        if np.abs(step).max() < tol:
            break
    return beta


def delinquency_drivers(cur: DataFrame, c_inverse_reg: float = 1.0) -> DataFrame:
    """L2 logistic regression on standardised drivers (the intercept unpenalised);
    coefficient and odds ratio per +1 SD, strongest first."""
    z = standardize(freeze(driver_frame(cur)), list(DRIVERS)).select("label", *[f"z_{d}" for d in DRIVERS]).persist(
        StorageLevel.MEMORY_AND_DISK)
    beta = fit_drivers(z, c_inverse_reg)
    z.unpersist()
    df = cur.sparkSession.createDataFrame(list(zip(DRIVERS, beta[1:].tolist())), "driver string, coef double")
    return df.select("driver", round_half_up(F.col("coef"), 3).alias("coef_per_sd"),
                     round_half_up(F.exp("coef"), 2).alias("odds_ratio_per_sd")) \
        .orderBy(F.col("odds_ratio_per_sd").desc(), "driver")


# The point at which ``driver_gradient`` evaluates the loss.
GRADIENT_AT = {"intercept": -1.5, "utilization": 0.8, "thin_file": 0.2, "fico_origination": -0.5, "log_income": -0.1,
               "age": 0.05}


def driver_gradient(cur: DataFrame, at: dict[str, float] = GRADIENT_AT, c_inverse_reg: float = 1.0) -> DataFrame:
    """Gradient of the fitted objective (mean log loss plus the L2 term) at given
    coefficients, by term (6 dp): what the fit drives to zero."""
    z = standardize(freeze(driver_frame(cur)), list(DRIVERS))
    line = F.lit(at["intercept"])
    for d in DRIVERS:
        line = line + F.lit(at[d]) * F.col(f"z_{d}")
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-line)) - F.col("label")
    one = z.agg(F.count(F.lit(1)).alias("_n"), F.avg(miss).alias("intercept"),
                *[F.avg(miss * F.col(f"z_{d}")).alias(d) for d in DRIVERS])
    terms = [F.struct(F.lit("intercept").alias("term"), F.col("intercept").alias("g"))]
    terms += [F.struct(F.lit(d).alias("term"), (F.col(d) + F.lit(at[d] / c_inverse_reg) / F.col("_n")).alias("g"))
              for d in DRIVERS]
    return one.select(F.explode(F.array(*terms)).alias("x")).select(
        "x.term", round_half_up(F.col("x.g"), 6).alias("gradient"))
