"""The query catalogue: one callable (spark, sf_dir) -> DataFrame per analysis.

Every query reads the bound test tables in full; nothing is sampled, capped or
subset to make it cheaper.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditscope.config import PortfolioConfig
from creditscope.operators.window import trim_after_event
from creditscope.plans import clean, cube, decision, kpis, load, models, quality, root_cause, state, trends
from creditscope.session import ensure_checkpoint_dir, freeze
from creditscope.sources.binding import bind_broken, bind_clean, bind_raw

CFG = PortfolioConfig()

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str):
    return bind_clean(spark, sf_dir)


def _cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.account_current(_tables(spark, sf_dir), CFG)


def _raw(spark: SparkSession, sf_dir: str):
    return bind_raw(spark, _tables(spark, sf_dir))


def _cleaned(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return clean.clean_table(_raw(spark, sf_dir), table)


def _on_current(fn) -> Query:
    return lambda spark, sf_dir: fn(_cur(spark, sf_dir))


def _on_tables(fn) -> Query:
    return lambda spark, sf_dir: fn(_tables(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "account_current": _cur,
    "portfolio_kpis": lambda spark, d: kpis.portfolio_kpis(kpis.current_balances(_tables(spark, d))),
    "delinquency_buckets": _on_tables(kpis.delinquency_buckets),
    "kpis_by_product": _on_tables(kpis.kpis_by_product),
    "kpis_by_region": _on_tables(kpis.kpis_by_region),
    "risk_tier_kpis": _on_current(kpis.risk_tier_kpis),
    "risk_tier_extract": _on_current(kpis.risk_tier_extract),
    "risk_concentration": _on_current(kpis.risk_concentration),
    "risk_deciles": _on_current(kpis.risk_deciles),
    "delinquency_by_utilization": _on_current(root_cause.delinquency_by_utilization),
    "utilization_extract": _on_current(root_cause.utilization_extract),
    "delinquency_by_file_depth": _on_current(root_cause.delinquency_by_file_depth),
    "file_depth_extract": _on_current(root_cause.file_depth_extract),
    "interaction_extract": _on_current(root_cause.interaction_extract),
    "delinquency_interaction": _on_current(root_cause.delinquency_interaction),
    "driver_segment_concentration": _on_current(root_cause.driver_segment_concentration),
    "monthly_trend": _on_tables(trends.monthly_trend),
    "monthly_trend_extract": _on_tables(trends.monthly_trend_extract),
    "roll_rates": _on_tables(trends.roll_rates),
    "vintage": _on_tables(trends.vintage),
    "clean_regions": lambda s, d: _cleaned(s, d, "regions"),
    "clean_card_products": lambda s, d: _cleaned(s, d, "card_products"),
    "clean_cardholders": lambda s, d: _cleaned(s, d, "cardholders"),
    "clean_accounts": lambda s, d: _cleaned(s, d, "accounts"),
    "clean_statements": lambda s, d: _cleaned(s, d, "monthly_statements"),
    "quality_report": lambda s, d: quality.quality_report(_raw(s, d)),
    "constraint_report": _on_tables(quality.check_constraints),
    "constraint_report_dirty": lambda s, d: quality.check_constraints(bind_broken(s, _tables(s, d))),
    "load_report_dirty": lambda s, d: load.load_report(load.gate(bind_broken(s, _tables(s, d)))),
    "load_kept_statements": lambda s, d: load.kept_rows(
        load.gate(bind_broken(s, _tables(s, d)))["monthly_statements"], "monthly_statements"),
    "table_counts": _on_tables(quality.table_counts),
    "behavior_segments": _on_current(models.behavior_segments),
    "segment_assign": _on_current(models.segment_assign),
    "delinquency_drivers": _on_current(models.delinquency_drivers),
    "driver_features": _on_current(models.driver_features),
    "cost_benefit": _on_current(decision.cost_benefit),
    "headline_findings": lambda s, d: _headline(s, d),
    "headline_metrics": lambda s, d: decision.headline_findings(_tables(s, d), _cur(s, d), cfg=CFG),
    "scored_sample": _on_current(decision.scored_sample),
    "scored_sample_500": _on_current(lambda cur: decision.scored_sample(cur, 500)),
    "portfolio_kpis_by_product_region_band": _on_current(lambda cur: kpis.portfolio_kpis(
        cur, ["product_id", "region_id", root_cause.utilization_band()])),
    "portfolio_cube": _on_current(lambda cur: cube.cube_kpis(cube.portfolio_cube(cur))),
    "portfolio_slice_stored": lambda s, d: _stored_slice(s, d),
    "behavior_segments_step": _on_current(models.segments_step),
    "behavior_segments_run": _on_current(models.segments_run),
    "driver_gradient": _on_current(models.driver_gradient),
    "trim_after_event": lambda s, d: trim_after_event(
        s.read.parquet(f"{d}/events.parquet"), ["user_id"], ["ts", "event_id"],
        F.col("event_type") == "purchase"),
    "statements_through_chargeoff": lambda s, d: trim_after_event(
        _tables(s, d)["monthly_statements"], ["account_id"], ["statement_month", "statement_id"],
        F.col("charge_off_flag") == 1),
}


def _stored_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portfolio by region, high utilization and not of the lowest tier, from a stored cube."""
    path = f"{ensure_checkpoint_dir(spark)}/cube-{uuid.uuid4().hex}"
    cube.write_cube(cube.portfolio_cube(_cur(spark, sf_dir)), path)
    return cube.cube_slice(cube.read_cube(spark, path), ["region_id"], {
        "utilization_band": root_cause.UTIL_LABELS[2:], "risk_tier": CFG.tier_labels[1:]})


def _headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    # The driver model and the record read the current state: derive it once, reliably.
    cur = freeze(state.account_current(t, CFG))
    return decision.headline_findings(t, cur, models.delinquency_drivers(cur), CFG)
