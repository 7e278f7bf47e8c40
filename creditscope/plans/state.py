"""Each account's current state: latest statement plus risk attributes (Q-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.operators.window import latest_per_key

Tables = dict[str, DataFrame]

CURRENT_COLUMNS = ("account_id", "cardholder_id", "product_id", "ending_balance", "credit_limit",
                   "days_past_due", "charge_off_flag", "utilization", "fico_origination",
                   "credit_history_months", "annual_income", "region_id", "thin_file",
                   "risk_points", "risk_tier", "age", "open_date", "statement_month")


def utilization(balance: Column, limit: Column) -> Column:
    return balance.cast("double") / F.nullif(limit, F.lit(0)).cast("double")


def risk_points(fico: Column, util: Column, thin: Column, cfg: PortfolioConfig) -> Column:
    lo_fico, hi_fico = cfg.fico_cuts
    mid_util, top_util = cfg.util_cuts
    fico_pts = F.when(fico < lo_fico, 2).when(fico < hi_fico, 1).otherwise(0)
    util_pts = F.when(util >= top_util, 2).when(util >= mid_util, 1).otherwise(0)
    thin_pts = F.when(thin, 1).otherwise(0)
    return (fico_pts + util_pts + thin_pts).cast("int")


def risk_tier(points: Column, cfg: PortfolioConfig) -> Column:
    t1, t2, t3, t4 = cfg.tier_labels
    return (F.when(points >= 4, t4).when(points == 3, t3)
            .when(points >= 1, t2).otherwise(t1))


def latest_statements(statements: DataFrame) -> DataFrame:
    """Latest statement per account (ties in a month: highest statement_id)."""
    cols = ["account_id", "statement_id", "statement_month", "ending_balance",
            "days_past_due", "charge_off_flag"]
    return latest_per_key(statements.select(*cols), ["account_id"],
                          ["statement_month", "statement_id"])


def account_current(t: Tables, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """One row per account at its latest statement.

    The latest row is picked on the narrow statement projection *before* the
    joins, so the joins see one row per account instead of the whole panel
    (same result as joining first: an account's statements all join or none do).
    """
    latest = latest_statements(t["monthly_statements"])
    acc = t["accounts"].select("account_id", "cardholder_id", "product_id", "credit_limit", "open_date")
    ch = t["cardholders"].select("cardholder_id", "fico_origination", "credit_history_months",
                                 "annual_income", "region_id", "age")
    cur = latest.join(acc, "account_id").join(ch, "cardholder_id")
    util = utilization(F.col("ending_balance"), F.col("credit_limit"))
    thin = F.col("credit_history_months") < cfg.thin_file_months
    cur = (cur.withColumn("utilization", util)
           .withColumn("thin_file", thin)
           .withColumn("risk_points", risk_points(F.col("fico_origination"), F.col("utilization"),
                                                  F.col("thin_file"), cfg))
           .withColumn("risk_tier", risk_tier(F.col("risk_points"), cfg)))
    return cur.select(*CURRENT_COLUMNS)


def register_current_view(t: Tables, cfg: PortfolioConfig = PortfolioConfig(),
                          name: str = "v_account_current") -> DataFrame:
    """Register the current state as a session temp view (replacing any
    previous one) so SQL users can query it by name; returns the frame."""
    cur = account_current(t, cfg)
    cur.createOrReplaceTempView(name)
    return cur
