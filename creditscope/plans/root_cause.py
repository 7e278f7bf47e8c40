"""Root-cause views of delinquency (Q-9..Q-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.functions.exprs import band, half_up, rate
from creditscope.operators.aggregate import share_of_total
from creditscope.plans.kpis import count_if

CFG = PortfolioConfig()

# Utilization band edges and labels (query form, left-closed,
# NULL in the top band) and dashboard form (right-closed, NULL dropped).
UTIL_EDGES = (0.30, 0.60, 0.90)
UTIL_LABELS = ("1 <30%", "2 30-60%", "3 60-90%", "4 90%+")
UTIL_EXTRACT_LABELS = ("<30%", "30-60%", "60-90%", "90%+")
UTIL_EXTRACT_FLOOR = -0.01
THIN_LABEL, ESTABLISHED_LABEL = "Thin file (<24 mo)", "Established file"
HIGH_UTIL, LOWER_UTIL = "High util (>=60%)", "Lower util (<60%)"
GRID_THIN, GRID_ESTABLISHED = "Thin file", "Established"
HIGH_SEGMENT, REST_SEGMENT = "High-util or thin-file", "Rest of book"


def _delinquent(cfg: PortfolioConfig):
    return F.col("days_past_due") >= cfg.delinquent_dpd


def utilization_band(null_label: str | None = None):
    """The query's band of utilization; NULL is in the last band unless labelled."""
    return band(F.col("utilization"), UTIL_EDGES, UTIL_LABELS, null_label=null_label).alias("utilization_band")


def delinquency_by_utilization(cur: DataFrame, cfg: PortfolioConfig = CFG,
                               null_label: str | None = None) -> DataFrame:
    """Q-9: four utilization bands, their delinquency rate and share of all delinquents;
    ``null_label`` gives accounts without utilization a row of their own."""
    g = cur.groupBy(utilization_band(null_label)).agg(
        F.count(F.lit(1)).alias("accounts"), count_if(_delinquent(cfg)).alias("_del"))
    g = share_of_total(g, "accounts", "pct_of_accounts", 1)
    g = share_of_total(g, "_del", "pct_of_all_delinquents", 1)
    return g.select("utilization_band", "accounts", "pct_of_accounts",
                    rate("_del", "accounts").alias("delinquency_rate_pct"),
                    "pct_of_all_delinquents").orderBy("utilization_band")


def utilization_extract(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Dashboard form of Q-9: right-closed bands above -0.01, NULL utilization
    dropped; account share is over all accounts."""
    u = F.col("utilization")
    banded = cur.withColumn("utilization_band", F.when(u > UTIL_EXTRACT_FLOOR,
                                                       band(u, UTIL_EDGES, UTIL_EXTRACT_LABELS, right=True)))
    g = banded.groupBy("utilization_band").agg(F.count(F.lit(1)).alias("accounts"),
                                               count_if(_delinquent(cfg)).alias("delinquents"))
    g = g.withColumn("_all", F.sum("accounts").over(Window.partitionBy()))
    g = share_of_total(g.filter(F.col("utilization_band").isNotNull()), "delinquents", "pct_of_all_delinquents", 1)
    return g.select("utilization_band", "accounts", "delinquents",
                    rate("delinquents", "accounts").alias("delinquency_rate"),
                    rate("accounts", "_all", 1).alias("pct_of_accounts"),
                    "pct_of_all_delinquents").orderBy("utilization_band")


def delinquency_by_file_depth(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-10: thin vs established credit file (grouped on the flag; a NULL flag
    is its own group labelled established, as an SQL ELSE does)."""
    g = cur.groupBy("thin_file").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("credit_history_months").alias("_hs"), F.count("credit_history_months").alias("_hn"),
        count_if(_delinquent(cfg)).alias("_del"),
        count_if(F.col("charge_off_flag") == 1).alias("_co"))
    label = F.when(F.col("thin_file"), THIN_LABEL).otherwise(ESTABLISHED_LABEL)
    return g.select(label.alias("file_depth"), "accounts",
                    half_up("_hs", "_hn", 0).alias("avg_history_months"),
                    rate("_del", "accounts").alias("delinquency_rate_pct"),
                    rate("_co", "accounts").alias("charge_off_rate_pct")).orderBy("file_depth")


def delinquency_interaction(cur: DataFrame, include_total: bool = True,
                            cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-11: utilization (>= 60%) x file depth grid, plus a grand-total row
    (NULL labels) via GROUPING SETS."""
    high = F.col("utilization") >= cfg.util_cuts[0]
    banded = cur.select(F.when(high, HIGH_UTIL).otherwise(LOWER_UTIL).alias("utilization_band"),
                        F.when(F.col("thin_file"), GRID_THIN).otherwise(GRID_ESTABLISHED).alias("file_depth"),
                        "days_past_due")
    aggs = [F.count(F.lit(1)).alias("accounts"), count_if(_delinquent(cfg)).alias("_del")]
    if include_total:
        g = banded.groupingSets([["utilization_band", "file_depth"], []],
                                "utilization_band", "file_depth").agg(*aggs)
    else:
        g = banded.groupBy("utilization_band", "file_depth").agg(*aggs)
    return g.select("utilization_band", "file_depth", "accounts",
                    rate("_del", "accounts").alias("delinquency_rate_pct")).orderBy(
        F.col("utilization_band").asc_nulls_last(), F.col("file_depth").asc_nulls_last())


def driver_segment_concentration(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Q-12: (high utilization OR thin file) vs rest of book.  The flag is
    three-valued; its NULL group keeps its own row, labelled rest of book."""
    flag = (F.col("utilization") >= cfg.util_cuts[0]) | F.col("thin_file")
    co = F.col("charge_off_flag") == 1
    g = cur.groupBy(flag.alias("_flag")).agg(
        F.count(F.lit(1)).alias("accounts"), count_if(_delinquent(cfg)).alias("_del"),
        F.sum(F.when(co, F.col("ending_balance"))).alias("_cobal"))
    g = share_of_total(g, "accounts", "pct_of_accounts", 1)
    g = share_of_total(g, "_del", "pct_of_all_delinquents", 1)
    g = share_of_total(g, "_cobal", "pct_of_chargeoff_balance", 1, money=True)
    label = F.when(F.col("_flag"), HIGH_SEGMENT).otherwise(REST_SEGMENT)
    return g.select(label.alias("segment"), "accounts", "pct_of_accounts",
                    rate("_del", "accounts").alias("delinquency_rate_pct"),
                    "pct_of_all_delinquents", "pct_of_chargeoff_balance").orderBy(
        F.col("_flag").desc_nulls_first())


def file_depth_extract(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Dashboard form of Q-10: grouped on the flag with NULL history counted as
    established (False), flag column kept next to the label."""
    thin = F.coalesce(F.col("thin_file"), F.lit(False))
    g = cur.groupBy(thin.alias("thin_file")).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("credit_history_months").alias("_hs"), F.count("credit_history_months").alias("_hn"),
        count_if(_delinquent(cfg)).alias("_del"),
        count_if(F.col("charge_off_flag") == 1).alias("_co"))
    return g.select("thin_file", "accounts", half_up("_hs", "_hn", 0).alias("avg_history_months"),
                    rate("_del", "accounts").alias("delinquency_rate"),
                    rate("_co", "accounts").alias("charge_off_rate"),
                    F.when(F.col("thin_file"), THIN_LABEL).otherwise(ESTABLISHED_LABEL).alias("file_depth")
                    ).orderBy("thin_file")


def interaction_extract(cur: DataFrame, cfg: PortfolioConfig = CFG) -> DataFrame:
    """Dashboard form of Q-11: the 2x2 grid on boolean flags (NULL counts as
    False), no total row, combined segment label."""
    hi = F.coalesce(F.col("utilization") >= cfg.util_cuts[0], F.lit(False))
    thin = F.coalesce(F.col("thin_file"), F.lit(False))
    g = cur.groupBy(hi.alias("util_hi"), thin.alias("thin_file")).agg(
        F.count(F.lit(1)).alias("accounts"), count_if(_delinquent(cfg)).alias("_del"))
    label = F.concat(F.when(F.col("util_hi"), HIGH_UTIL).otherwise(LOWER_UTIL),
                     F.when(F.col("thin_file"), " + " + GRID_THIN).otherwise(" + " + GRID_ESTABLISHED))
    return g.select("util_hi", "thin_file", "accounts", rate("_del", "accounts").alias("delinquency_rate"),
                    label.alias("segment")).orderBy("util_hi", "thin_file")
