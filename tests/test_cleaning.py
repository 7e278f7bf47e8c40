"""Cleaning rules on hand-written raw rows (FIXTURES §4)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from creditscope.plans.clean import (clean_accounts, clean_all, clean_cardholders, clean_statements,
                                     enforce_integrity)
from creditscope.schema import raw_schema

def placed(spark, rows, schema):
    """Raw rows with their input position."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema.add("_row_pos", "long")) if not any(
        f.name == "_row_pos" for f in schema.fields) else spark.createDataFrame(
            [(*r, i) for i, r in enumerate(rows)], schema)


def ch_rows(spark, rows):
    return placed(spark, rows, raw_schema("cardholders"))


def audit_dict(audit):
    return {(r.table_name, r.check_name): r.cnt for r in audit.collect()}


def test_cardholder_repairs(spark):
    rows = [("1", "0", "$50,000.00", "SELF-EMPLOYED", "1", "250", "12"),
            ("2", "199", "", "self-employed", "1", "900", ""),
            ("3", None, "40000", " ", "1", "700", "30"),
            ("4", "40", "USD 30000", None, "2", "710", "40"),
            ("5", "61", "n/a", "employed", "2", None, "50"),
            ("6", "58", "20000", "Retired", "2", "690", "60")]
    for _ in range(1):
        out, audit = clean_cardholders(ch_rows(spark, rows))
        got = {r.cardholder_id: r for r in out.collect()}
        # valid ages 40, 61, 58 -> median 58; three repaired/imputed
        assert [got[i].age for i in (1, 2, 3)] == [58, 58, 58]
        # incomes 50000, 40000, 30000, 20000 -> median 35000.00
        assert got[2].annual_income == Decimal("35000.00") and got[5].annual_income == Decimal("35000.00")
        assert got[1].annual_income == Decimal("50000.00")
        assert got[1].employment_status == "Self-Employed" and got[3].employment_status == "Unknown"
        assert got[4].employment_status == "Unknown" and got[5].employment_status == "Employed"
        assert (got[1].fico_origination, got[2].fico_origination, got[5].fico_origination) == (300, 850, None)
        assert got[2].credit_history_months == 0
        a = audit_dict(audit)
        assert a[("cardholders", "impossible_ages_fixed")] == 2
        assert a[("cardholders", "missing_income_imputed")] == 2
        assert a[("cardholders", "employment_blanks_filled")] == 2
        assert a[("cardholders", "fico_out_of_range_clipped")] == 2
        assert a[("cardholders", "exact_duplicates_removed")] == 0


def test_age_median_half_even(spark):
    rows = [(str(i), str(a), "1", "Employed", "1", "700", "10") for i, a in enumerate([40, 77, 300], start=1)]
    rows.append(("9", None, "1", "Employed", "1", "700", "10"))
    out, _ = clean_cardholders(ch_rows(spark, rows))
    # valid ages 40, 77 -> 58.5 -> half-even 58
    assert {r.cardholder_id: r.age for r in out.collect()}[9] == 58


def test_account_key_dedupe_first_wins_and_limit_rule(spark):
    raw = placed(spark,
        [("7", "7", "1", "2024-01-05", "$100.00"), ("7", "7", "1", "2024-01-05", "200"),
         ("7", "7", "1", "2024-01-05", "$100.00"), ("8", "8", "1", "Jan 05 2024", "0"),
         ("9", "9", "2", "01/05/2024", "1,000")], raw_schema("accounts"))
    raw = raw.repartition(3)
    out, audit = clean_accounts(raw)
    got = {r.account_id: r.credit_limit for r in out.collect()}
    assert got == {7: Decimal("100.00"), 9: Decimal("1000.00")}
    a = audit_dict(audit)
    assert a[("accounts", "duplicate_accounts_removed")] == 2
    assert a[("accounts", "nonpositive_limit_dropped")] == 1
    assert a[("accounts", "rows_out")] == 2


def test_statement_payment_rules(spark):
    rows = [("1", "1", "2024-01-31", "0", "10", "-25.00", "10", "25", "0", "0"),
            ("2", "1", "2024-02-29", "0", "10", "-0.00", "10", "25", "0", "0"),
            ("3", "1", "2024-03-31", "0", "10", "", "$1,010.00", "25", "30", ""),
            ("3", "1", "2024-03-31", "0", "10", "", "$1,010.00", "25", "30", "")]
    out, audit = clean_statements(placed(spark, rows, raw_schema("monthly_statements")))
    got = {r.statement_id: r for r in out.collect()}
    assert got[1].payment_amount == Decimal("25.00") and got[2].payment_amount == Decimal("0.00")
    assert got[3].payment_amount == Decimal("0.00") and got[3].ending_balance == Decimal("1010.00")
    assert got[3].charge_off_flag == 0 and got[3].days_past_due == 30
    a = audit_dict(audit)
    assert a[("monthly_statements", "negative_payments_corrected")] == 1
    assert a[("monthly_statements", "missing_payments_zeroed")] == 1
    assert a[("monthly_statements", "exact_duplicates_removed")] == 1


def test_fk_cascade(spark):
    regions = spark.createDataFrame([(1, "North")], "region_id int, region_name string")
    products = spark.createDataFrame([(1, "Std")], "product_id int, product_name string")
    ch = spark.createDataFrame([(10, 1), (11, 99), (12, None)], "cardholder_id long, region_id int")
    ac = spark.createDataFrame([(100, 10, 1), (101, 11, 1), (102, 10, 5), (103, 12, 1)],
                               "account_id long, cardholder_id long, product_id int")
    st = spark.createDataFrame([(1, 100), (2, 101), (3, 102), (4, 103), (5, None)], "statement_id long, account_id long")
    res = enforce_integrity({"regions": regions, "card_products": products, "cardholders": ch,
                             "accounts": ac, "monthly_statements": st})
    assert sorted(r.cardholder_id for r in res.tables["cardholders"].collect()) == [10]
    assert sorted(r.account_id for r in res.tables["accounts"].collect()) == [100]
    assert sorted(r.statement_id for r in res.tables["monthly_statements"].collect()) == [1]
    a = audit_dict(res.audit)
    assert a[("cardholders", "orphan_region_fk_dropped")] == 2
    assert a[("accounts", "orphan_fk_dropped")] == 3
    assert a[("monthly_statements", "orphan_account_fk_dropped")] == 4


def test_round_trip_on_bound_fixture(spark):
    from creditscope.sources.binding import bind_clean, bind_raw
    from tests.conftest import SF001
    clean = bind_clean(spark, SF001)
    res = clean_all(bind_raw(spark, clean))
    expect = clean["accounts"].filter("account_id % 53 <> 0 and account_id % 211 <> 0")
    assert res.tables["accounts"].exceptAll(expect).count() == 0
    assert expect.exceptAll(res.tables["accounts"]).count() == 0


def test_missing_scores_stay_missing(spark):
    texts = ["NAN", " nan", "700d", "700f", "inf", "-Infinity", "1e3", "700.0", "", None]
    rows = [(str(i), "40", "1", "Employed", "1", t, "10") for i, t in enumerate(texts)]
    out, audit = clean_cardholders(ch_rows(spark, rows))
    got = {r.cardholder_id: r.fico_origination for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == [None] * 6 + [850, 700, None, None]
    assert audit_dict(audit)[("cardholders", "fico_out_of_range_clipped")] == 1  # 1e3 only


def test_oversized_amounts_count_as_missing(spark):
    rows = [("1", "40", "12345678901.00", "Employed", "1", "700", "10"), ("2", "40", "500", "Employed", "1", "700", "10")]
    out, audit = clean_cardholders(ch_rows(spark, rows))
    assert {r.cardholder_id: r.annual_income for r in out.collect()} == {1: Decimal("500.00"), 2: Decimal("500.00")}
    assert audit_dict(audit)[("cardholders", "missing_income_imputed")] == 1
    raw = placed(spark, [("1", "1", "1", "2024-01-05", "99999999999999")], raw_schema("accounts"))
    assert clean_accounts(raw)[0].collect() == []


def test_raw_rows_need_a_position(spark):
    with pytest.raises(ValueError):
        clean_accounts(spark.createDataFrame([("1", "1", "1", "2024-01-05", "5")], raw_schema("accounts")))


def test_table_by_table_equals_all(spark):
    from creditscope.plans.clean import clean_table
    from creditscope.sources.binding import bind_clean, bind_raw
    from tests.conftest import SF001
    raw = bind_raw(spark, bind_clean(spark, SF001))
    whole = clean_all(raw).tables
    for name, df in whole.items():
        one = clean_table(raw, name)
        assert one.columns == df.columns
        assert one.exceptAll(df).count() == 0 and df.exceptAll(one).count() == 0, name


def test_every_audit_count_can_be_nonzero(spark):
    """A dirty set of tables in which all 18 counts but the reference ones differ from zero."""
    ch = [("1", "40", "", "Employed", "1", "700", "10"), ("1", "40", "", "Employed", "1", "700", "10"),
          ("2", "199", "100", "", "9", "100", "10"), ("3", "30", "100", "x", "1", "900", "")]
    ac = [("1", "1", "1", "2024-01-05", "100"), ("1", "1", "1", "01/05/2024", "$100"), ("2", "1", "1", "", "0"),
          ("3", "2", "1", "", "5"), ("4", "1", "7", "", "5")]
    st = [("1", "1", "2024-01-31", "0", "1", "-2", "3", "4", "0", "0")] * 2 + [
        ("2", "1", "2024-02-29", "0", "1", "", "3", "4", "0", "0"), ("3", "3", "", "0", "1", "2", "3", "4", "0", "0")]
    raw = {"cardholders": ch_rows(spark, ch), "accounts": placed(spark, ac, raw_schema("accounts")),
           "monthly_statements": placed(spark, st, raw_schema("monthly_statements")),
           "regions": spark.createDataFrame([("1", "North")], "region_id string, region_name string"),
           "card_products": spark.createDataFrame([("1", "Std", "0.1", "5")],
                                                  "product_id string, product_name string, base_apr string, annual_fee string")}
    a = audit_dict(clean_all(raw).audit)
    assert len(a) == 18 and all(a.values())
    assert a[("cardholders", "fico_out_of_range_clipped")] == 2
    assert a[("cardholders", "exact_duplicates_removed")] == 1
    assert a[("accounts", "duplicate_accounts_removed")] == 1
    assert a[("accounts", "orphan_fk_dropped")] == 2
    assert a[("monthly_statements", "orphan_account_fk_dropped")] == 1


def test_constraint_report_finds_every_kind(spark, tables001):
    from creditscope.plans.quality import check_constraints
    from creditscope.schema import CONSTRAINTS
    broken = {}
    for i, (name, df) in enumerate(tables001.items()):
        first = df.limit(1)
        nulls = first.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
        odd = first.select(*[F.lit(-7 - i).cast(t).alias(c) if t.startswith(("int", "bigint", "decimal", "smallint"))
                             else F.col(c) for c, t in df.dtypes])
        broken[name] = df.unionByName(first).unionByName(nulls).unionByName(odd)
    got = {(r.table_name, r.constraint_name): r.violations for r in check_constraints(broken).collect()}
    assert len(got) == len(CONSTRAINTS)
    kinds = {c.kind: [] for c in CONSTRAINTS}
    for c in CONSTRAINTS:
        kinds[c.kind].append(got[(c.table, c.name)])
    assert all(v > 0 for v in kinds["not_null"]) and all(v > 0 for v in kinds["pk"]) and all(v > 0 for v in kinds["fk"])
    assert any(v > 0 for v in kinds["check"])


def test_existence_flags(spark):
    from creditscope.plans.clean import with_existence
    rows = spark.createDataFrame([(1, 1, 10), (2, 9, 10), (3, None, 10), (4, 1, 11), (5, 2, None)], "id int, a int, b int")
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(10,)], "a int")
    got = with_existence(rows, "ok", a=a, b=b)
    assert {r.id: r.ok for r in got.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert got.columns == ["id", "a", "b", "ok"] and got.count() == 5
    assert with_existence(rows, "ok", a=a.limit(0)).where("ok").count() == 0



def test_audit_counted_while_writing(spark, tables001, tmp_path):
    """The audit of the write equals the audit computed apart, and the rows are the same."""
    from creditscope.plans.clean import clean_all, clean_and_write
    from creditscope.plans.quality import ordered_audit
    from creditscope.sources.binding import bind_raw
    raw = bind_raw(spark, tables001)
    apart = clean_all(raw)

    def write(name, rows):
        rows.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    audit = clean_and_write(raw, write)
    assert [tuple(r) for r in ordered_audit(audit).collect()] == [tuple(r) for r in ordered_audit(apart.audit).collect()]
    for name, df in apart.tables.items():
        written = spark.read.parquet(str(tmp_path / name)).select(*df.columns)
        assert written.exceptAll(df).count() == 0 and written.count() == df.count(), name
