"""Trend and transition analyses over the statement panel (Q-13..Q-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.functions.exprs import rate, round_half_up
from creditscope.operators.window import next_value
from creditscope.plans.kpis import avg_pct, count_if, current_balances
from creditscope.plans.state import utilization

Tables = dict[str, DataFrame]
CFG = PortfolioConfig()


def monthly_trend(t: Tables, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-13: per statement month over *all* statements: row count, delinquency
    and charge-off rates, average utilization, and the month-over-month change
    of the rounded delinquency rate."""
    limits = t["accounts"].select("account_id", "credit_limit")
    s = t["monthly_statements"].select("account_id", "statement_month", "ending_balance",
                                       "days_past_due", "charge_off_flag").join(limits, "account_id")
    g = s.groupBy("statement_month").agg(
        F.count(F.lit(1)).alias("active_accounts"),
        count_if(F.col("days_past_due") >= cfg.delinquent_dpd).alias("_del"),
        count_if(F.col("charge_off_flag") == 1).alias("_co"),
        F.sum(utilization(F.col("ending_balance"), F.col("credit_limit"))).alias("_us"),
        F.count(utilization(F.col("ending_balance"), F.col("credit_limit"))).alias("_un"))
    g = g.select("statement_month", "active_accounts",
                 rate("_del", "active_accounts").alias("delinquency_rate_pct"),
                 rate("_co", "active_accounts").alias("charge_off_rate_pct"),
                 avg_pct("_us", "_un").alias("avg_utilization_pct"))
    # One row per month: the unpartitioned window runs over the aggregate only.
    prev = F.lag("delinquency_rate_pct").over(Window.orderBy("statement_month"))
    return g.select("statement_month", "active_accounts", "delinquency_rate_pct",
                    round_half_up(F.col("delinquency_rate_pct") - prev, 2).alias("delinquency_mom_change"),
                    "charge_off_rate_pct", "avg_utilization_pct").orderBy("statement_month")


def roll_bucket(dpd):
    return (F.when(dpd == 0, "0 Current").when(dpd < 60, "1 30 DPD")
            .when(dpd < 90, "2 60 DPD").otherwise("3 90+ DPD"))


def roll_rates(t: Tables) -> DataFrame:
    """Q-14: per from-bucket, share of statements whose account's next
    statement is more past due (roll forward) or current (cure; staying
    current counts).  The account's last statement has no successor."""
    s = t["monthly_statements"].select("account_id", "statement_id", "statement_month", "days_past_due")
    seq = next_value(s, ["account_id"], ["statement_month", "statement_id"], "days_past_due", "next_dpd")
    cls = seq.filter(F.col("next_dpd").isNotNull())
    g = cls.groupBy(roll_bucket(F.col("days_past_due")).alias("from_bucket")).agg(
        F.count(F.lit(1)).alias("observations"),
        count_if(F.col("next_dpd") > F.col("days_past_due")).alias("_fwd"),
        count_if(F.col("next_dpd") == 0).alias("_cure"))
    return g.select("from_bucket", "observations",
                    rate("_fwd", "observations", 1).alias("roll_forward_rate_pct"),
                    rate("_cure", "observations", 1).alias("cure_rate_pct")).orderBy("from_bucket")


def vintage(t: Tables, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-15: current delinquency by account origination year."""
    cur = current_balances(t)
    g = cur.groupBy(F.year("open_date").cast("int").alias("vintage_year")).agg(
        F.count(F.lit(1)).alias("accounts"),
        count_if(F.col("days_past_due") >= cfg.delinquent_dpd).alias("_del"),
        count_if(F.col("charge_off_flag") == 1).alias("_co"))
    return g.select("vintage_year", "accounts", rate("_del", "accounts").alias("delinquency_rate_pct"),
                    rate("_co", "accounts").alias("charge_off_rate_pct")).orderBy("vintage_year")


def monthly_trend_extract(t: Tables, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Dashboard form of Q-13: ISO month text and the extract's column names."""
    m = monthly_trend(t, cfg)
    return m.select(F.date_format("statement_month", "yyyy-MM-dd").alias("statement_month"),
                    "active_accounts",
                    F.col("delinquency_rate_pct").alias("delinquency_rate"),
                    F.col("charge_off_rate_pct").alias("charge_off_rate"),
                    F.col("avg_utilization_pct").alias("avg_utilization"),
                    "delinquency_mom_change").orderBy("statement_month")
