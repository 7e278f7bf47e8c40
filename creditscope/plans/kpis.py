"""Portfolio KPIs and risk-tier views (Q-1..Q-4, Q-6..Q-8).

Every analysis aggregates to a handful of groups first; shares of the total
are windows over those few rows only.  Dimension names are joined onto the
aggregated rows, not onto the account-level rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.functions.exprs import half_up, rate, round_half_up, share
from creditscope.operators.aggregate import share_of_total
from creditscope.operators.ranking import ntile_distributed
from creditscope.plans.state import latest_statements, utilization
from creditscope.schema import MONEY_OUT

Tables = dict[str, DataFrame]
CFG = PortfolioConfig()


def money(c: Column) -> Column:
    return c.cast(MONEY_OUT)


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def current_balances(t: Tables) -> DataFrame:
    """Latest statement joined to its account's limit and keys (no cardholder join)."""
    acc = t["accounts"].select("account_id", "cardholder_id", "product_id", "credit_limit", "open_date")
    cur = latest_statements(t["monthly_statements"]).join(acc, "account_id")
    return cur.withColumn("utilization", utilization(F.col("ending_balance"), F.col("credit_limit")))


def _partials(dpd: int) -> list[Column]:
    """Re-aggregatable pieces: counts and sums, never rounded values."""
    return [F.count(F.lit(1)).alias("n"),
            F.sum("utilization").alias("util_sum"), F.count("utilization").alias("util_n"),
            count_if(F.col("days_past_due") >= dpd).alias("delinquent"),
            count_if(F.col("charge_off_flag") == 1).alias("charged_off"),
            F.sum("ending_balance").alias("balance")]


def _merge_partials() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("util_sum").alias("util_sum"),
            F.sum("util_n").alias("util_n"), F.sum("delinquent").alias("delinquent"),
            F.sum("charged_off").alias("charged_off"), F.sum("balance").alias("balance")]


def avg_pct(sum_col: str, n_col: str, digits: int = 1) -> Column:
    return round_half_up(F.col(sum_col) / F.col(n_col) * F.lit(100.0), digits)


def portfolio_sums() -> list[Column]:
    late, co = F.col("days_past_due"), F.col("charge_off_flag") == 1
    return [F.count(F.lit(1)).alias("accounts"), F.sum("ending_balance").alias("_bal"),
            F.sum("utilization").alias("_us"), F.count("utilization").alias("_un"), F.sum("credit_limit").alias("_lim"),
            count_if(late >= 30).alias("_d30"), count_if(late >= 60).alias("_d60"), count_if(late >= 90).alias("_d90"),
            count_if(co).alias("_co"), F.sum(F.when(co, F.col("ending_balance"))).alias("_cobal")]


def portfolio_columns() -> list[tuple[str, Column]]:
    return [("accounts", F.col("accounts")), ("total_balance", money(F.col("_bal"))),
            ("avg_utilization_pct", avg_pct("_us", "_un")), ("portfolio_utilization_pct", share("_bal", "_lim", 1)),
            ("delinquency_rate_30plus_pct", rate("_d30", "accounts")),
            ("delinquency_rate_60plus_pct", rate("_d60", "accounts")),
            ("delinquency_rate_90plus_pct", rate("_d90", "accounts")), ("charge_off_rate_pct", rate("_co", "accounts")),
            ("charge_off_balance_pct", share("_cobal", "_bal", 2)),
            ("charge_off_balance", money(F.coalesce(F.col("_cobal"), F.lit(0))))]


def portfolio_kpis(cur: DataFrame, by: Sequence[Column | str] = ()) -> DataFrame:
    """Q-1: headline KPIs over the current state, optionally sliced by ``by`` (columns
    or named expressions, such as a utilization band)."""
    agg = cur.groupBy(*by).agg(*portfolio_sums())
    keys = agg.columns[:len(by)]
    return agg.select(*keys, *[c.alias(n) for n, c in portfolio_columns()])


def aging_bucket(dpd: Column, flag: Column) -> Column:
    return (F.when(flag == 1, "6 Charged Off").when(dpd == 0, "1 Current")
            .when(dpd < 60, "2 30 DPD").when(dpd < 90, "3 60 DPD")
            .when(dpd < 120, "4 90 DPD").otherwise("5 120+ DPD"))


def delinquency_buckets(t: Tables) -> DataFrame:
    """Q-2: aging buckets of each account's latest statement."""
    latest = latest_statements(t["monthly_statements"])
    grouped = (latest.groupBy(aging_bucket(F.col("days_past_due"), F.col("charge_off_flag"))
                              .alias("delinquency_bucket"))
               .agg(F.count(F.lit(1)).alias("accounts")))
    return share_of_total(grouped, "accounts", "pct_of_portfolio", 2).orderBy("delinquency_bucket")


def _segment_kpis(parts: DataFrame, name: str, with_balance: bool) -> DataFrame:
    g = parts.groupBy(name).agg(*_merge_partials())
    cols = [F.col(name), F.col("n").alias("accounts"), avg_pct("util_sum", "util_n").alias("avg_utilization_pct"),
            rate("delinquent", "n").alias("delinquency_rate_pct"),
            rate("charged_off", "n").alias("charge_off_rate_pct")]
    if with_balance:
        cols.append(money(F.col("balance")).alias("total_balance"))
    return g.select(*cols).orderBy(F.col("delinquency_rate_pct").desc(), F.col(name))


def kpis_by_product(t: Tables, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-3: KPIs per card product, worst delinquency first."""
    parts = current_balances(t).groupBy("product_id").agg(*_partials(cfg.delinquent_dpd))
    named = parts.join(t["card_products"].select("product_id", "product_name"), "product_id")
    return _segment_kpis(named, "product_name", with_balance=True)


def kpis_by_region(t: Tables, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-4: KPIs per region, through the cardholder's region."""
    cur = current_balances(t).join(t["cardholders"].select("cardholder_id", "region_id"), "cardholder_id")
    parts = cur.groupBy("region_id").agg(*_partials(cfg.delinquent_dpd))
    named = parts.join(t["regions"].select("region_id", "region_name"), "region_id")
    return _segment_kpis(named, "region_name", with_balance=False)


def _tier_aggregate(cur: DataFrame, cfg: PortfolioConfig) -> DataFrame:
    co = F.col("charge_off_flag") == 1
    return cur.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("fico_origination").alias("_fs"), F.count("fico_origination").alias("_fn"),
        F.sum("utilization").alias("_us"), F.count("utilization").alias("_un"),
        count_if(F.col("thin_file")).alias("_thin"),
        count_if(F.col("days_past_due") >= cfg.delinquent_dpd).alias("_del"),
        count_if(co).alias("_co"),
        F.sum("ending_balance").alias("_bal"),
        F.sum(F.when(co, F.col("ending_balance"))).alias("_cobal"))


def risk_tier_kpis(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-6 (flagship): nine measures per risk tier with account and balance shares."""
    g = share_of_total(_tier_aggregate(cur, cfg), "accounts", "pct_of_accounts", 1)
    g = share_of_total(g, "_bal", "pct_of_balance", 1, money=True)
    return g.select(
        "risk_tier", "accounts", "pct_of_accounts",
        half_up("_fs", "_fn", 0).alias("avg_fico"),
        avg_pct("_us", "_un").alias("avg_utilization_pct"),
        rate("_thin", "accounts", 1).alias("pct_thin_file"),
        rate("_del", "accounts").alias("delinquency_rate_pct"),
        rate("_co", "accounts").alias("charge_off_rate_pct"),
        money(F.col("_bal")).alias("total_balance"),
        "pct_of_balance").orderBy("risk_tier")


def risk_tier_extract(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Dashboard form of Q-6: 2-dp percentages, charge-off balance and its share
    (0.0, not NULL, for a tier without charge-offs)."""
    g = _tier_aggregate(cur, cfg).withColumn("_cobal0", F.coalesce(F.col("_cobal"), F.lit(0)))
    g = share_of_total(g, "accounts", "pct_of_accounts", 1)
    g = share_of_total(g, "_bal", "pct_of_balance", 1, money=True)
    g = share_of_total(g, "_cobal0", "pct_of_chargeoff_balance", 1, money=True)
    return g.select(
        "risk_tier", "accounts",
        half_up("_fs", "_fn", 0).alias("avg_fico"),
        avg_pct("_us", "_un", 2).alias("avg_utilization"),
        rate("_thin", "accounts", 2).alias("pct_thin_file"),
        rate("_del", "accounts", 2).alias("delinquency_rate"),
        rate("_co", "accounts", 2).alias("charge_off_rate"),
        money(F.col("_bal")).alias("total_balance"),
        "pct_of_accounts", "pct_of_balance",
        money(F.col("_cobal0")).alias("charge_off_balance"),
        F.coalesce(F.col("pct_of_chargeoff_balance"), F.lit(0.0)).alias("pct_of_chargeoff_balance"),
    ).orderBy("risk_tier")


def risk_concentration(cur: DataFrame) -> DataFrame:
    """Q-7: each tier's share of balance and of charged-off balance (NULL when
    the tier has none)."""
    co = F.col("charge_off_flag") == 1
    g = cur.groupBy("risk_tier").agg(F.sum("ending_balance").alias("_bal"),
                                     F.sum(F.when(co, F.col("ending_balance"))).alias("_cobal"))
    g = share_of_total(g, "_bal", "pct_total_balance", 1, money=True)
    g = share_of_total(g, "_cobal", "pct_charged_off_balance", 1, money=True)
    return g.select("risk_tier", "pct_total_balance", "pct_charged_off_balance").orderBy("risk_tier")


def risk_score(util: Column, fico: Column) -> Column:
    """Higher is riskier: 0.6 * min(utilization, 1) + 0.4 * (850 - FICO) / 550."""
    return (F.lit(0.6) * F.least(util, F.lit(1.0))
            + F.lit(0.4) * (F.lit(850) - fico).cast("double") / F.lit(550.0))


def risk_deciles(cur: DataFrame, k: int = 10, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-8: NTILE(k) of the risk score (NULL scores last, ties by account_id)
    and the delinquency gradient across tiles, without a single-partition sort."""
    scored = cur.select("account_id", "days_past_due", "utilization", "fico_origination",
                        risk_score(F.col("utilization"), F.col("fico_origination")).alias("risk_score"))
    tiled = ntile_distributed(scored, k, [F.col("risk_score").asc_nulls_last(), F.col("account_id").asc()],
                              "risk_decile")
    g = tiled.groupBy("risk_decile").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("utilization").alias("_us"), F.count("utilization").alias("_un"),
        F.sum("fico_origination").alias("_fs"), F.count("fico_origination").alias("_fn"),
        count_if(F.col("days_past_due") >= cfg.delinquent_dpd).alias("_del"))
    return g.select("risk_decile", "accounts", avg_pct("_us", "_un").alias("avg_utilization_pct"),
                    half_up("_fs", "_fn", 0).alias("avg_fico"),
                    rate("_del", "accounts").alias("delinquency_rate_pct")).orderBy("risk_decile")
