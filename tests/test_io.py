"""Readers and sinks: raw CSV with missing-value tokens, clean tables, extracts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from creditscope.plans import decision, state
from creditscope.plans.clean import clean_accounts, clean_all
from creditscope.schema import LOAD_ORDER
from creditscope.sources.binding import bind_raw
from creditscope.sources.io import read_raw, read_tables, write_extracts, write_json, write_tables


def test_read_raw_null_tokens(spark, tmp_path):
    path = tmp_path / "ch.csv"
    path.write_text("cardholder_id,age,annual_income,employment_status,region_id,fico_origination,"
                    "credit_history_months\n1,NA,\"$1,000.00\",N/A,1,700,12\n2,40,,Employed,1,NULL,\n")
    df = read_raw(spark, str(path), "cardholders")
    rows = {r.cardholder_id: r for r in df.collect()}
    assert rows["1"].age is None and rows["1"].employment_status is None
    assert rows["1"].annual_income == "$1,000.00" and rows["2"].fico_origination is None
    assert "_row_pos" in df.columns


HEADER = "account_id,cardholder_id,product_id,open_date,credit_limit\n"


def test_read_raw_by_header_name_and_quotes(spark, tmp_path):
    path = tmp_path / "regions.csv"
    path.write_text('region_name,region_id\nWest,1\n"say ""hi"", all",2\n')
    got = {r.region_id: r.region_name for r in read_raw(spark, str(path), "regions").collect()}
    assert got == {"1": "West", "2": 'say "hi", all'}
    path.write_text('region_id,region_name\n1,"two\nlines"\n')
    assert read_raw(spark, str(path), "regions", multi_line=True).first().region_name == "two\nlines"


@pytest.mark.parametrize("row", ["1,1,1,2024-01-05,5,extra", "1,1,1"])
def test_read_raw_raises_on_broken_rows(spark, tmp_path, row):
    path = tmp_path / "accounts.csv"
    path.write_text(HEADER + row + "\n2,2,1,2024-01-05,5\n")
    with pytest.raises(Exception):
        read_raw(spark, str(path), "accounts").collect()


def test_read_raw_needs_its_columns(spark, tmp_path):
    path = tmp_path / "regions.csv"
    path.write_text("region_id,other\n1,West\n")
    with pytest.raises(ValueError):
        read_raw(spark, str(path), "regions")


def test_first_row_wins_across_files(spark, tmp_path):
    folder = tmp_path / "accounts.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text(HEADER + "1,1,1,2024-01-05,100\n")
    more = "".join(f"{i},{i},1,2024-01-05,7\n" for i in range(2, 3000))
    (folder / "part-1.csv").write_text(HEADER + "1,1,1,2024-01-05,200\n" + more)
    out, _ = clean_accounts(read_raw(spark, str(folder), "accounts"))
    assert out.where("account_id = 1").first().credit_limit == 100
    assert out.count() == 2999


def test_raw_csv_round_trip_and_sinks(spark, tables001, tmp_path):
    raw = bind_raw(spark, tables001)
    raw_dir = tmp_path / "raw"
    for name in LOAD_ORDER:
        raw[name].drop("_row_pos").write.option("header", True).csv(str(raw_dir / name))
    reread = {name: read_raw(spark, str(raw_dir / name), name) for name in LOAD_ORDER}
    a = clean_all(reread)
    b = clean_all(raw)
    for name in LOAD_ORDER:
        assert a.tables[name].exceptAll(b.tables[name]).count() == 0, name
        assert b.tables[name].exceptAll(a.tables[name]).count() == 0, name
    out = tmp_path / "clean"
    write_tables(a.tables, str(out), fmt="csv")
    back = read_tables(spark, str(out), fmt="csv")
    assert back["monthly_statements"].exceptAll(a.tables["monthly_statements"]).count() == 0
    write_tables(a.tables, str(tmp_path / "pq"), partition_statements_by_month=True)
    pq = read_tables(spark, str(tmp_path / "pq"))
    assert pq["accounts"].count() == a.tables["accounts"].count()


def test_extracts_and_json(spark, tables001, tmp_path):
    cur = state.register_current_view(tables001)
    assert spark.sql("select count(*) from v_account_current").first()[0] == cur.count()
    ex = decision.extracts(tables001, cur)
    write_extracts(ex, str(tmp_path / "extracts"))
    files = os.listdir(tmp_path / "extracts" / "risk_tier_kpis")
    assert len([f for f in files if f.endswith(".csv")]) == 1
    write_json(decision.headline_findings(tables001, cur), str(tmp_path / "kpis"))
    part = [f for f in os.listdir(tmp_path / "kpis") if f.endswith(".json")][0]
    rec = json.loads((tmp_path / "kpis" / part).read_text().splitlines()[0])
    assert rec["accounts"] == cur.count() and rec["cli_growth_share_assumption_pct"] == 19.0


def test_portfolio_kpis_sliced_by_tier(spark, tables001):
    cur = state.account_current(tables001)
    by = decision.kpis.portfolio_kpis(cur, by=["risk_tier"])
    assert by.agg(F.sum("accounts")).first()[0] == cur.count()


def test_bucketed_tables_avoid_panel_shuffle(spark, tables001, tmp_path):
    from creditscope.sources.io import read_catalog_tables, write_bucketed
    write_bucketed(tables001, str(tmp_path / "bucketed"), 4, prefix="t_bkt_")
    t = read_catalog_tables(spark, "t_bkt_")
    cur = state.account_current(t)
    rows = sorted(tuple(r) for r in cur.collect())
    assert rows == sorted(tuple(r) for r in state.account_current(tables001).collect())
    plan = cur._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "hashpartitioning(account_id" not in plan


def test_pipeline_end_to_end(spark, tables001, tmp_path):
    from creditscope.pipeline import run_analytics, run_cleaning
    raw = bind_raw(spark, tables001)
    for name in LOAD_ORDER:
        raw[name].drop("_row_pos").write.option("header", True).csv(str(tmp_path / "raw" / f"{name}.csv"))
    clean = run_cleaning(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    expect = tables001["accounts"].filter("account_id % 53 <> 0 and account_id % 211 <> 0").count()
    assert clean["accounts"].count() == expect
    audit = [json.loads(line) for f in os.listdir(tmp_path / "out/reports/data_quality_report")
             if f.endswith(".json") for line in (tmp_path / "out/reports/data_quality_report" / f).read_text().splitlines()]
    assert len(audit) == 18
    findings = run_analytics(spark, str(tmp_path / "out/processed"), str(tmp_path / "out")).first()
    assert findings.accounts == clean["monthly_statements"].select("account_id").distinct().count()
    assert findings.top_driver is not None
    extracts = sorted(os.listdir(tmp_path / "out/extracts"))
    names = ("risk_tier_kpis", "delinquency_by_utilization", "delinquency_by_filedepth", "delinquency_interaction",
             "monthly_delinquency_trend", "kmeans_segments", "delinquency_drivers", "account_scored_sample")
    # Beside the named files, the local file system keeps its own checksum files.
    assert [f for f in extracts if not f.startswith(".")] == sorted(f"{n}.csv" for n in names)
    assert (tmp_path / "out/extracts/risk_tier_kpis.csv").read_text().startswith("risk_tier,accounts")
