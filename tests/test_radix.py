"""Radix selection against sorted values and the engine's percentile."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from creditscope.operators.radix import key_value, radix_medians, with_order_key
from tests.conftest import SF001

EDGES = [0.0, 5e-324, 2.2250738585072009e-308, 2.2250738585072014e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2),
         8.0, math.nextafter(8.0, 0), math.nextafter(8.0, 9), 0.1, 1e300, 1.7976931348623157e308, math.inf]


def bits(x):
    n = struct.unpack(">q", struct.pack(">d", abs(x)))[0]
    return -n if x < 0 else n


def test_keys_are_the_bits_and_come_back(spark):
    rnd = random.Random(5)
    values = EDGES + [struct.unpack(">d", rnd.randbytes(8))[0] for _ in range(4000)] + [
        math.ldexp(1.0, e) for e in range(-1074, 1024)] + [math.nextafter(math.ldexp(1.0, e), 0) for e in range(-1073, 1024)]
    values = [x for x in values if not math.isnan(x)]
    values += [-x for x in values if x]
    rows = with_order_key(spark.createDataFrame([(x,) for x in values], "v double"), "v", "k").withColumn(
        "back", key_value(F.col("k"))).collect()
    assert all(r.k == bits(r.v) and r.back == r.v for r in rows)
    odd = with_order_key(spark.createDataFrame([(math.nan,), (None,), (-0.0,)], "v double"), "v", "k").collect()
    assert odd[0].k > bits(math.inf) and odd[1].k is None and odd[2].k == 0


@pytest.mark.parametrize("n", [1, 2, 7, 500, 501])
def test_medians_equal_percentile(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.gauss(0, 1e6), float(rnd.randint(-2, 2)), 7.5 if i % 3 == 0 else rnd.random(),
             None if i % 2 else rnd.uniform(-1, 1), None) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = radix_medians(df, df.columns).first()
    want = df.agg(*[F.percentile(c, 0.5).alias(c) for c in df.columns]).first()
    assert tuple(got) == tuple(want)


def test_empty_frame_and_money(spark):
    empty = spark.createDataFrame([], "a double, b decimal(12,2)")
    assert tuple(radix_medians(empty, ["a", "b"]).first()) == (None, None)
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    want = orders.agg(F.percentile(F.col("o_totalprice").cast("double"), 0.5)).first()[0]
    assert radix_medians(orders, ["o_totalprice"]).first()[0] == want


def test_plan_has_no_range_exchange_and_no_sort_of_values(spark):
    df = spark.range(1000).select((F.col("id") * 1.5).alias("v"))
    plan = radix_medians(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "BroadcastHashJoin" in plan and "Cartesian" not in plan
