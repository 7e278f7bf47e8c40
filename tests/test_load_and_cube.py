"""The load gate and the stored cube."""

import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from creditscope.plans import cube, kpis, load, state
from creditscope.plans.root_cause import UTIL_LABELS, utilization_band
from creditscope.schema import LOAD_ORDER, TABLES
from creditscope.sources.io import read_table, write_named_extracts


def small(spark):
    month, one = datetime.date(2024, 1, 31), decimal.Decimal(1)
    rows = {
        "regions": [(1, "n"), (1, "m"), (2, None), (None, "x")],
        "card_products": [(1, "p", one, one), (2, "q", -one, one)],
        "cardholders": [(1, 30, one, "e", 1, 700, 5), (2, 17, one, "e", 1, 700, 5), (3, None, None, None, 1, None, None),
                        (4, 30, one, "e", 2, 700, 5), (1, 30, one, "e", 9, 700, 5), (1, 30, one, "e", 1, 700, 5)],
        "accounts": [(10, 1, 1, month, one), (11, 2, 1, month, one), (12, 3, 2, month, one), (13, 3, 1, month, -one)],
        "monthly_statements": [(100, 10, month, one, one, one, one, one, 0, 0)] * 4 + [
            (100, 10, month, one, one, one, one, one, 0, 2), (101, 11, month, one, one, one, one, one, 0, 1)],
    }
    loose = {t: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TABLES[t].fields) for t in LOAD_ORDER}
    return {t: spark.createDataFrame(rows[t], loose[t]) for t in LOAD_ORDER}


def test_every_kind_of_fault_is_named(spark):
    judged = load.gate(small(spark))
    got = {(r.table_name, r.outcome): r.rows for r in load.load_report(judged).collect()}
    assert got == {
        ("regions", "loaded"): 1, ("regions", "regions_pkey"): 1, ("regions", "region_name_not_null"): 1,
        ("regions", "region_id_not_null"): 1,
        ("card_products", "loaded"): 1, ("card_products", "base_apr_check"): 1,
        ("cardholders", "loaded"): 2, ("cardholders", "age_check"): 1, ("cardholders", "cardholders_region_id_fkey"): 2,
        ("cardholders", "cardholders_pkey"): 1,
        ("accounts", "loaded"): 1, ("accounts", "accounts_cardholder_id_fkey"): 1, ("accounts", "accounts_product_id_fkey"): 1,
        ("accounts", "credit_limit_check"): 1,
        ("monthly_statements", "loaded"): 1, ("monthly_statements", "monthly_statements_pkey"): 3,
        ("monthly_statements", "charge_off_flag_check"): 1, ("monthly_statements", "monthly_statements_account_id_fkey"): 1}
    assert load.kept_rows(judged["regions"], "regions").first().region_name == "m"


def test_a_load_appears_whole_and_once(spark, tmp_path):
    t = small(spark)
    load.publish(t, str(tmp_path), "first")
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["first"]
    assert read_table(spark, str(tmp_path / "first/accounts"), "accounts").count() == 1
    rejected = spark.read.parquet(str(tmp_path / "first/rejected/monthly_statements"))
    assert rejected.agg(F.sum("copies")).first()[0] == 5
    with pytest.raises(FileExistsError):
        load.publish(t, str(tmp_path), "first")


def test_empty_tables_load(spark):
    judged = load.gate({t: df.limit(0) for t, df in small(spark).items()})
    assert load.load_report(judged).count() == 0


def test_clean_tables_pass_the_gate(spark, tables001):
    judged = load.gate(tables001)
    assert {r.outcome for r in load.load_report(judged).collect()} == {"loaded"}


def test_slices_of_the_stored_cube(spark, tables001, tmp_path):
    cur = state.account_current(tables001)
    cur = cur.withColumn("utilization", F.when(F.col("account_id") % 11 != 0, F.col("utilization"))).cache()
    cube.write_cube(cube.portfolio_cube(cur), str(tmp_path / "cube"))
    stored = cube.read_cube(spark, str(tmp_path / "cube"))
    banded = cur.withColumn("utilization_band", utilization_band())
    asked = [((), {}), (("risk_tier",), {}), (("product_id", "region_id"), {"utilization_band": UTIL_LABELS[3]}),
             (("region_id",), {"product_id": [1, 3], "utilization_band": list(UTIL_LABELS[2:])}),
             ((), {"region_id": [0, 4]}), (("risk_tier", "utilization_band"), {"risk_tier": "none such"})]
    for by, where in asked:
        rows = banded
        for name, value in where.items():
            rows = rows.where(F.col(name).isin(value if isinstance(value, list) else [value]))
        want = kpis.portfolio_kpis(rows, list(by))
        got = cube.cube_slice(stored, by, where)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (by, where)
    one_level = cube.cube_slice(stored, ["region_id"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(grouping_level" in one_level
    with pytest.raises(ValueError):
        cube.cube_slice(stored, ["age"])


def test_extracts_get_their_names(spark, tmp_path):
    for n in (3, 5):
        write_named_extracts({"table": spark.range(n).coalesce(1)}, str(tmp_path))
        assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["table.csv"]
        assert (tmp_path / "table.csv").read_text().splitlines() == ["id", *map(str, range(n))]
