"""Generic operators on edge rows and on the driver tables (FIXTURES §4, §5)."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from creditscope.operators import (deterministic_sample, exact_medians, global_rank, keep_first,
                                   keep_referenced, latest_per_key, next_value, ntile_distributed,
                                   orphans, share_of_total, trim_after_event)
from tests.conftest import SF001, SF01


def test_latest_per_key_tie_break(spark):
    df = spark.createDataFrame([(1, 10, "2024-01-31", 5), (1, 11, "2024-01-31", 6), (1, 9, "2023-12-31", 7),
                                (2, 20, "2024-01-31", 8)], "k long, sid long, m string, v int")
    got = {r.k: r.sid for r in latest_per_key(df, ["k"], ["m", "sid"]).collect()}
    assert got == {1: 11, 2: 20}


def test_latest_per_key_plan_limits_before_shuffle(spark):
    orders = spark.read.parquet(f"{SF001}/orders.parquet")
    df = latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_latest_per_key_matches_sql_on_orders(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    ours = latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey")
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    ref = orders.withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_orderkey")
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_keep_first_by_position(spark):
    df = spark.createDataFrame([(7, "$100", 0), (7, "200", 1), (8, "5", 2)], "account_id long, lim string, pos long")
    got = {r.account_id: r.lim for r in keep_first(df, ["account_id"], "pos").collect()}
    assert got == {7: "$100", 8: "5"}


@pytest.mark.parametrize("flags,kept", [((0, 1, 1, 1), 2), ((0, 1, 0, 1), 3), ((0, 0), 2), ((1, 1), 1)])
def test_trim_after_event(spark, flags, kept):
    rows = [(1, i, f) for i, f in enumerate(flags)] + [(2, 0, 1), (2, 1, 1)]
    df = spark.createDataFrame(rows, "k long, t int, f int")
    out = trim_after_event(df, ["k"], ["t"], F.col("f") == 1)
    assert out.filter("k = 1").count() == kept
    assert out.filter("k = 2").count() == 1
    assert out.columns == df.columns


def test_trim_after_event_on_events_matches_running_sum(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    ours = trim_after_event(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    ref = ev.withColumn("c", F.sum(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).over(w)) \
        .filter("c <= 1").drop("c")
    assert sorted(r.event_id for r in ours.collect()) == sorted(r.event_id for r in ref.collect())


def test_next_value_roll_edge(spark):
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate([0, 0, 30, 0])], "k long, t int, dpd int")
    got = [r.nx for r in next_value(df, ["k"], ["t"], "dpd", "nx").orderBy("t").collect()]
    assert got == [0, 30, 0, None]


def test_ntile_sizes_23_rows(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(23)], "id long, s double")
    tiled = ntile_distributed(df, 10, [F.col("s").asc(), F.col("id").asc()], "tile", partitions=4)
    sizes = [r["count"] for r in tiled.groupBy("tile").count().orderBy("tile").collect()]
    assert sizes == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_ntile_matches_window_with_ties_and_nulls(spark):
    rnd = random.Random(7)
    rows = [(i, None if rnd.random() < 0.05 else float(rnd.randint(0, 20))) for i in range(1009)]
    df = spark.createDataFrame(rows, "id long, s double")
    order = [F.col("s").asc_nulls_last(), F.col("id").asc()]
    ours = ntile_distributed(df, 10, order, "tile", partitions=7).select("id", "tile")
    ref = df.withColumn("tile", F.ntile(10).over(Window.orderBy(*order))).select("id", "tile")
    assert sorted(ours.collect()) == sorted(ref.collect())


def test_global_rank_hot_value(spark):
    # A third of the rows share one value: the tie-break splits it across ranges.
    rows = [(i, 5.0 if i % 3 == 0 else float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v double")
    ranked = global_rank(df, [F.col("v"), F.col("id")], partitions=6)
    got = [r.id for r in ranked.orderBy("_rank").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert ranked.agg(F.max("_total")).first()[0] == 3000


def test_exact_medians_vs_python(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random() * 100, None if i % 7 == 0 else float(rnd.randint(1, 9))) for i in range(501)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = exact_medians(df, ["a", "b"]).first()

    def med(xs):
        xs = sorted(x for x in xs if x is not None)
        n = len(xs)
        return xs[n // 2] if n % 2 else (xs[n // 2 - 1] + xs[n // 2]) / 2

    assert got.a == pytest.approx(med([r[1] for r in rows]))
    assert got.b == pytest.approx(med([r[2] for r in rows]))
    pct = df.agg(F.percentile("a", 0.5).alias("a"), F.percentile("b", 0.5).alias("b")).first()
    assert pct.a == pytest.approx(got.a) and pct.b == pytest.approx(got.b)
    none = exact_medians(df.limit(0), ["a", "b"]).first()
    assert none.a is None and none.b is None


def test_exact_medians_hot_value(spark):
    rows = [(5.0 if i % 3 == 0 else float(i),) for i in range(900)]
    df = spark.createDataFrame(rows, "v double")
    values = sorted(r[0] for r in rows)
    for parts in (1, 3, 20):
        assert exact_medians(df, ["v"], partitions=parts).first().v == (values[449] + values[450]) / 2


def test_deterministic_sample_exact_size_and_order(spark):
    df = spark.range(5000).withColumnRenamed("id", "account_id")
    s1 = deterministic_sample(df, 300, 42, "account_id")
    ids = sorted(r.account_id for r in s1.collect())
    brute = sorted(r.account_id for r in df.orderBy(F.md5(F.concat(F.col("account_id").cast("string"), F.lit("-42"))),
                                                     "account_id").limit(300).collect())
    assert len(ids) == 300 and ids == brute
    assert sorted(r.account_id for r in deterministic_sample(df.repartition(13), 300, 42, "account_id").collect()) == ids


def test_share_of_total_lineitem(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    out = share_of_total(g, "n", "pct", 2).collect()
    assert abs(sum(r.pct for r in out) - 100.0) < 0.01 * len(out)


def test_signed_zero_discount_normalises(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    neg_zero = li.filter((F.col("l_discount") == 0) & (F.signum(F.col("l_discount")) == 0))
    as_money = li.select(F.col("l_discount").cast("decimal(12,2)").alias("d")).filter("d = 0")
    assert neg_zero.count() == as_money.count()
    assert as_money.filter(F.col("d") < 0).count() == 0


def test_semi_anti_join_customers(spark):
    cust = spark.read.parquet(f"{SF01}/customer.parquet")
    orders = spark.read.parquet(f"{SF01}/orders.parquet").filter(F.col("o_orderkey") % 3 == 0)
    with_o = keep_referenced(cust, "c_custkey", orders, "o_custkey").count()
    without = orphans(cust, "c_custkey", orders, "o_custkey").count()
    assert with_o + without == cust.count() and without > 0


def window_lead(df):
    w = Window.partitionBy("k").orderBy("t")
    return df.withColumn("nx", F.lead("dpd").over(w)).select("k", "t", "nx").collect()


def row_key(r):
    return r.k is None, r.k or 0, r.t


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_next_value_matches_window(spark, partitions):
    rnd = random.Random(11)
    # key 0 holds a third of the rows, NULL another part; some ranges are empty
    rows = [(0 if i % 3 == 0 else None if i % 7 == 0 else rnd.randint(1, 40), i, rnd.choice([None, 0, 30, 60, 90]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, t int, dpd int")
    got = next_value(df, ["k"], ["t"], "dpd", "nx", partitions).select("k", "t", "nx").collect()
    assert sorted(got, key=row_key) == sorted(window_lead(df), key=row_key)
    assert next_value(df.limit(0), ["k"], ["t"], "dpd", "nx").collect() == []


def test_next_value_one_plan_for_every_size(spark):
    """The hot key's rows lie in many ranges, and no job counts keys."""
    df = spark.range(4000).selectExpr("0L as k", "cast(id as int) as t", "cast(id % 4 as int) as dpd")
    got = next_value(df, ["k"], ["t"], "dpd", "nx", 8)
    assert got.where("nx is null").count() == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lead" in plan and "_pid" in plan


def test_sample_of_a_small_table_is_ordered(spark):
    df = spark.range(40).withColumnRenamed("id", "account_id").repartition(3)
    got = [r.account_id for r in deterministic_sample(df, 300, 42, "account_id").collect()]
    want = [r.account_id for r in df.orderBy(F.md5(F.concat(F.col("account_id").cast("string"), F.lit("-42")))).collect()]
    assert got == want
    assert deterministic_sample(df.limit(0), 5, 1, "account_id").collect() == []


def test_trim_after_event_null_order_value_comes_last(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, None, 0), (2, None, 0), (2, 1, 1)], "k long, t int, f int")
    got = trim_after_event(df, ["k"], ["t"], F.col("f") == 1).collect()
    assert sorted((r.k, r.t is None, r.t or 0) for r in got) == [(1, False, 1), (2, False, 1), (2, True, 0)]


def test_period_trend_on_orders_matches_duckdb(spark):
    import duckdb

    from creditscope.functions.exprs import rate, round_half_up
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    month = F.last_day(F.col("o_orderdate").cast("date")).alias("m")
    g = orders.groupBy(month).agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(F.col("o_orderpriority").startswith("1")).alias("u"))
    g = g.select("m", "n", rate("u", "n", 2).alias("r"))
    g = g.select("m", "n", "r", round_half_up(F.col("r") - F.lag("r").over(Window.orderBy("m")), 2).alias("chg"))
    ours = sorted(tuple(r) for r in g.collect())
    con = duckdb.connect()
    ref = con.execute(f"""
        with g as (select last_day(cast(o_orderdate as date)) as m, count(*) as n,
                          count(*) filter (where o_orderpriority like '1%') as u
                   from read_parquet('{SF01}/orders.parquet') group by 1),
             r as (select m, n, cast((2 * u * 10000 + n) // (2 * n) as double) / 100 as r from g)
        select m, n, r, cast(round(cast(r - lag(r) over (order by m) as decimal(38,10)), 2) as double) from r
    """).fetchall()
    assert ours == sorted(tuple(x) for x in ref)


def test_trim_after_event_null_key_matches_window(spark):
    rows = [(None, i, f) for i, f in enumerate([0, 1, 0, 1, 1])] + [(3, i, f) for i, f in enumerate([1, 0, 1])]
    df = spark.createDataFrame(rows, "k long, t int, f int")
    ours = trim_after_event(df, ["k"], ["t"], F.col("f") == 1)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("c", F.sum("f").over(w)).filter("c <= 1").drop("c")
    key = lambda r: (r.k is None, r.k or 0, r.t)
    assert sorted(ours.collect(), key=key) == sorted(ref.collect(), key=key)
