"""Edge rows for the column expressions (FIXTURES §4)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from creditscope.functions import exprs as X


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def col_values(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_parse_money_valid(spark):
    df = one_col(spark, ["$1,234.50", "1234.5", "USD 12", "-$5.00"])
    got = col_values(df, X.parse_money(F.col("v")).cast("decimal(12,2)"))
    assert got == [Decimal("1234.50"), Decimal("1234.50"), Decimal("12.00"), Decimal("-5.00")]


def test_parse_money_blank_and_junk(spark):
    df = one_col(spark, [None, "", " ", "nan", "None", "N/A", "abc", "(5.00)"])
    assert col_values(df, X.parse_money(F.col("v"))) == [None] * 8


def test_parse_money_negative_zero_is_not_negative(spark):
    df = one_col(spark, ["-0.0"])
    v = df.select(X.parse_money(F.col("v")).alias("m")).select(F.col("m"), (F.col("m") < 0).alias("neg")).first()
    assert v.m == 0 and v.neg is False


def test_parse_date_formats(spark):
    df = one_col(spark, ["2024-01-05", "01/05/2024", "1/5/2024", "Jan 05 2024", "January 5 2024", " jan 5 2024 "])
    assert col_values(df, X.parse_date(F.col("v"))) == [dt.date(2024, 1, 5)] * 6


def test_parse_date_invalid(spark):
    df = one_col(spark, [None, "", "NaT", "none", "13/45/2024", "2024-02-30"])
    assert col_values(df, X.parse_date(F.col("v"))) == [None] * 6


def test_title_case(spark):
    df = one_col(spark, ["SELF-EMPLOYED", "self-employed", " Retired "])
    assert col_values(df, X.title_case(F.trim(F.col("v")))) == ["Self-Employed", "Self-Employed", "Retired"]


def test_blank_fill(spark):
    df = one_col(spark, [None, "", " ", "nan", "None", "<NA>", "Employed"])
    assert col_values(df, X.fill_blank_text(F.col("v"))) == ["Unknown"] * 6 + ["Employed"]


def test_null_tokens(spark):
    df = one_col(spark, ["NA", "N/A", "NULL", "#N/A", "x", ""])
    assert col_values(df, X.null_tokens_to_null(F.col("v"))) == [None, None, None, None, "x", None]


def test_clip_and_null_outside(spark):
    df = one_col(spark, [250, 900, 700, None], "int")
    assert col_values(df, X.clip(F.col("v"), 300, 850)) == [300, 850, 700, None]
    df = one_col(spark, [0, 1, 199, 250, 40, None], "int")
    assert col_values(df, X.null_outside(F.col("v"), 18, 100)) == [None, None, None, None, 40, None]


def test_band_left_closed_and_null(spark):
    df = one_col(spark, [0.30, 0.60, 0.90, None, 0.1], "double")
    labels = ("1", "2", "3", "4")
    assert col_values(df, X.band(F.col("v"), (0.3, 0.6, 0.9), labels)) == ["2", "3", "4", "4", "1"]
    assert col_values(df, X.band(F.col("v"), (0.3, 0.6, 0.9), labels, right=True)) == ["1", "2", "3", "4", "1"]


def test_rate_rounds_ties_half_up(spark):
    df = spark.createDataFrame([(57, 20000), (1, 3), (2, 3), (0, 5), (5, 0)], "k long, n long")
    assert col_values(df, X.rate(F.col("k"), F.col("n"), 2)) == [0.29, 33.33, 66.67, 0.0, None]


def test_ratio_half_up_sign_aware(spark):
    df = spark.createDataFrame([(-1, 8), (1, -8), (-3, 2)], "a long, b long")
    # -0.125 -> -0.13 (half away from zero), -1.5 -> -2
    assert col_values(df, X.ratio_half_up(F.col("a"), F.col("b"), 2, 0)) == [-0.13, -0.13, -1.5]
    got = col_values(df, X.ratio_half_up(F.col("a"), F.col("b"), 0, 0))
    assert got == [0.0, 0.0, -2.0] and str(got[0]) == "0.0"


def test_share_of_money(spark):
    df = spark.createDataFrame([(Decimal("1.00"), Decimal("8.00"))], "p decimal(12,2), t decimal(12,2)")
    assert col_values(df, X.share(F.col("p"), F.col("t"), 1)) == [12.5]


def test_round_half_even_for_median_age(spark):
    df = one_col(spark, [58.5, 59.5, 60.0], "double")
    assert [int(v) for v in col_values(df, X.round_half_even(F.col("v"), 0))] == [58, 60, 60]
