"""Plan properties the scale design relies on."""

import pytest

import __spark_entry__ as E
from creditscope import catalog
from creditscope.operators.ranking import approximate_medians, exact_medians
from tests.conftest import SF001

Q = {name: fn for name, fn in E.queries().items() if name in catalog.QUERIES}


def final_plan(spark, name):
    df = Q[name](spark, SF001)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_latest_state_limits_before_shuffle(spark):
    plan = final_plan(spark, "account_current")
    assert "WindowGroupLimit" in plan and "Partial" not in plan.split("WindowGroupLimit")[0][-5:]
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_deciles_have_no_global_window_over_rows(spark):
    plan = final_plan(spark, "risk_deciles")
    assert "ntile" not in plan.lower()
    assert "rangepartitioning" in plan or "Scan ExistingRDD" in plan


def test_trim_after_event_uses_top2_not_running_window(spark):
    plan = final_plan(spark, "trim_after_event")
    assert "WindowGroupLimit" in plan
    # the only window is the per-key row_number limited to 2; no running sum over all rows
    assert "Window [sum(" not in plan
    assert ", 2, Partial" in plan or "2, Partial" in plan


def test_no_cartesian_products(spark):
    for name in ("headline_findings", "quality_report", "segment_assign"):
        plan = final_plan(spark, name)
        assert "CartesianProduct" not in plan, name


def test_approx_median_is_opt_in(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 9, 10, 11])], "id long, v double")
    assert exact_medians(df, ["v"]).first().v == pytest.approx(6.0)
    assert approximate_medians(df, ["v"]).first().v in (3.0, 9.0)


@pytest.mark.parametrize("name", ["account_current", "clean_cardholders", "clean_accounts", "constraint_report",
                                  "kpis_by_region"])
def test_dimension_lookups_do_not_shuffle_big_tables(spark, name):
    plan = final_plan(spark, name).split("Initial Plan")[0]
    for key in ("c_nationkey", "region_id", "product_id"):
        assert f"SortMergeJoin [{key}" not in plan and f"ShuffledHashJoin [{key}" not in plan, key
    assert "hashpartitioning(c_nationkey" not in plan


@pytest.mark.parametrize("name,exchanges", [("accounts", 6), ("monthly_statements", 8)])
def test_cleaning_runs_nothing_before_it_is_asked(spark, tables001, name, exchanges):
    from creditscope.plans.clean import clean_table
    from creditscope.sources.binding import bind_raw
    raw = bind_raw(spark, tables001)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"plan-{name}", "building the query")
    df = clean_table(raw, name)
    assert len(tracker.getJobIdsForGroup(f"plan-{name}")) == 0
    spark.sparkContext.setJobGroup("run", "running it")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= exchanges
