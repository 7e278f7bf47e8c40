"""Decision layer: cost-benefit, headline findings, scored sample (Q-18..Q-20)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.functions.exprs import ratio_half_up, round_half_up, share
from creditscope.operators.sampling import deterministic_sample
from creditscope.plans import kpis, root_cause, trends
from creditscope.schema import MONEY_OUT

CFG = PortfolioConfig()
Tables = dict[str, DataFrame]


def _cents(c):
    return (c * F.lit(100)).cast("decimal(38,0)")


def decision_sums(cfg: PortfolioConfig = CFG) -> list:
    high = F.col("risk_tier").isin(*cfg.high_risk_tiers)
    co = F.col("charge_off_flag") == 1
    bal = F.col("ending_balance")
    return [F.coalesce(F.sum(F.when(cond, bal)), F.lit(0)).alias(name) for name, cond in (
        ("_hco", high & co), ("_aco", co), ("_lperf", ~high & ~co), ("_perf", ~co))]


def decision_columns(cfg: PortfolioConfig = CFG, growth_share: float | None = None) -> list:
    g = Decimal(str(cfg.cli_growth_share if growth_share is None else growth_share))
    g_num, g_den = g.as_integer_ratio()
    no_co = F.col("_aco") == 0
    return [
        ("high_risk_co_balance", F.col("_hco").cast(MONEY_OUT)),
        ("high_risk_tier_share_of_chargeoff_balance_pct",
         F.when(no_co, F.lit(0.0)).otherwise(share("_hco", "_aco", 1))),
        ("cli_growth_share_assumption_pct", ratio_half_up(F.lit(g_num), F.lit(g_den), 0, pow10=2)),
        ("projected_chargeoff_exposure_reduction_pct", F.when(no_co, F.lit(0.0)).otherwise(
            ratio_half_up(_cents(F.col("_hco")) * F.lit(g_num), _cents(F.col("_aco")) * F.lit(g_den), 1, 2))),
        ("low_risk_performing_balance_share_pct", share("_lperf", "_perf", 1))]


def cost_benefit(cur: DataFrame, growth_share: float | None = None, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-18: high-risk tiers' share of charged-off balance, the exposure averted
    by withholding line increases from them (share x growth share, unrounded
    product), and the low-risk share of performing balance."""
    return cur.agg(*decision_sums(cfg)).select(*[c.alias(n) for n, c in decision_columns(cfg, growth_share)])


# The published keys of the headline record, in order.
HEADLINE_KEYS = (
    "accounts", "total_balance", "avg_utilization_pct", "portfolio_utilization_pct", "delinquency_rate_30plus_pct",
    "delinquency_rate_60plus_pct", "delinquency_rate_90plus_pct", "charge_off_rate_pct", "charge_off_balance",
    "delinquency_trend_start_pct", "delinquency_trend_end_pct", "high_util_band_delinquency_pct",
    "thin_file_delinquency_pct", "established_file_delinquency_pct", "worst_segment", "worst_segment_delinquency_pct",
    "top_driver", "top_driver_odds_ratio", "high_risk_tier_share_of_chargeoff_balance_pct",
    "cli_growth_share_assumption_pct", "projected_chargeoff_exposure_reduction_pct",
    "low_risk_performing_balance_share_pct")


def headline_findings(t: Tables, cur: DataFrame, drivers: DataFrame | None = None,
                      cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-19: one row of headline values, in the published key order.

    One aggregate of the current state gives every account-level value; the panel's
    first and last month come from the trend.  Bands follow the dashboard
    (right-closed) form; the worst grid cell is the highest rate, ties by label; the
    two driver keys need a fitted model and are there when ``drivers`` is given.
    """
    late = F.coalesce(F.col("days_past_due") >= cfg.delinquent_dpd, F.lit(False))
    high = F.coalesce(F.col("utilization") >= cfg.util_cuts[0], F.lit(False))
    thin = F.coalesce(F.col("thin_file"), F.lit(False))
    u, edges = F.col("utilization"), (root_cause.UTIL_EXTRACT_FLOOR, *root_cause.UTIL_EDGES)
    bands = [(u > lo) & (u <= hi) for lo, hi in zip(edges, edges[1:])] + [u > edges[-1]]
    groups = {f"_band{i}": b for i, b in enumerate(bands)} | {"_thin": thin, "_deep": ~thin}
    labels = {}
    for i, (is_high, util) in enumerate(((high, root_cause.HIGH_UTIL), (~high, root_cause.LOWER_UTIL))):
        for j, (is_thin, depth) in enumerate(((thin, root_cause.GRID_THIN), (~thin, root_cause.GRID_ESTABLISHED))):
            groups[f"_cell{i}{j}"] = is_high & is_thin
            labels[f"_cell{i}{j}"] = f"{util} + {depth}"
    counted = [x for name, cond in groups.items()
               for x in (kpis.count_if(cond).alias(f"{name}_n"), kpis.count_if(cond & late).alias(f"{name}_d"))]
    one = cur.agg(*kpis.portfolio_sums(), *decision_sums(cfg), *counted)
    rates = {name: ratio_half_up(F.col(f"{name}_d"), F.col(f"{name}_n"), 2, 2) for name in groups}
    cells = F.array_sort(F.filter(F.array(*[F.struct((-rates[c]).alias("r"), F.lit(label).alias("l"))
                                            for c, label in labels.items()]), lambda x: x["r"].isNotNull()))
    worst = F.get(cells, 0)
    headline = [*(c for c in kpis.portfolio_columns() if c[0] != "charge_off_balance_pct")]
    account = one.select(
        *[c.alias(n) for n, c in headline],
        # The last band that has accounts.
        F.coalesce(*[rates[f"_band{i}"] for i in reversed(range(len(bands)))]).alias("high_util_band_delinquency_pct"),
        rates["_thin"].alias("thin_file_delinquency_pct"), rates["_deep"].alias("established_file_delinquency_pct"),
        worst["l"].alias("worst_segment"), (-worst["r"]).alias("worst_segment_delinquency_pct"),
        *[c.alias(n) for n, c in decision_columns(cfg) if n != "high_risk_co_balance"])
    trend = trends.monthly_trend(t, cfg).agg(
        F.min_by("delinquency_rate_pct", "statement_month").alias("delinquency_trend_start_pct"),
        F.max_by("delinquency_rate_pct", "statement_month").alias("delinquency_trend_end_pct"))
    parts = [account, trend]
    if drivers is not None:
        parts.append(drivers.orderBy(F.col("odds_ratio_per_sd").desc(), "driver").limit(1).select(
            F.col("driver").alias("top_driver"), F.col("odds_ratio_per_sd").alias("top_driver_odds_ratio")))
    whole = one_row(parts)
    return whole.select(*[k for k in HEADLINE_KEYS if k in whole.columns])


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Side-by-side assembly of one-row frames without a join: stack them
    (each row carries only its own columns) and take each column's single
    non-NULL value."""
    cols = [c for p in parts for c in p.columns]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in cols])


# Columns of the published sample.
SAMPLE_COLUMNS = ("account_id", "risk_tier", "utilization", "fico_origination", "annual_income",
                  "credit_history_months", "thin_file", "days_past_due", "ending_balance",
                  "charge_off_flag", "product_id", "region_id")


def scored_sample(cur: DataFrame, n: int | None = None, seed: int | None = None,
                  cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-20: account-level scored extract, seeded exact-size sample."""
    out = cur.select(*[round_half_up(F.col(c), 4).alias(c) if c == "utilization" else F.col(c)
                       for c in SAMPLE_COLUMNS])
    return deterministic_sample(out, n or cfg.sample_size, cfg.seed if seed is None else seed, "account_id")


def extracts(t: Tables, cur: DataFrame, cfg: PortfolioConfig = CFG,
             segments: DataFrame | None = None, drivers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The small dashboard tables (aggregates only), by file name."""
    out = {
        "risk_tier_kpis": kpis.risk_tier_extract(cur, cfg),
        "delinquency_by_utilization": root_cause.utilization_extract(cur, cfg),
        "delinquency_by_filedepth": root_cause.file_depth_extract(cur, cfg),
        "delinquency_interaction": root_cause.interaction_extract(cur, cfg),
        "monthly_delinquency_trend": trends.monthly_trend_extract(t, cfg),
    }
    if segments is not None:
        out["kmeans_segments"] = segments
    if drivers is not None:
        out["delinquency_drivers"] = drivers
    return out
