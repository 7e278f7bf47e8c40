"""Scaling check: the heavy analyses on the sf0.1 panel replicated xN.

Copies of every clean table get ids offset per copy (so joins and windows see
N times more distinct accounts, not duplicates), are written once as Parquet
(statements partitioned by month) under a fresh scratch folder, read back with
the typed readers, and timed.  Usage:
  python tools/scale_bench.py <sf_dir> <scratch_dir> [--bucketed N] <factor> [factor ...]
With --bucketed N the tables are saved by ``write_bucketed`` (accounts and
statements in N buckets by account_id) instead of plain Parquet.
Prints one JSON line per factor.
"""

from __future__ import annotations

import json
import sys
import time

sys.path.insert(0, ".")
from pyspark.sql import functions as F  # noqa: E402

from creditscope.plans import kpis, root_cause, state, trends  # noqa: E402
from creditscope.session import get_spark  # noqa: E402
from creditscope.sources.binding import bind_clean  # noqa: E402
from creditscope.sources.io import (read_catalog_tables, read_tables, write_bucketed,  # noqa: E402
                                    write_tables)

OFFSET = 10_000_000_000


def replicate(t, factor):
    def copies(df, id_cols):
        out = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
        for c in id_cols:
            out = out.withColumn(c, F.col(c) + F.col("_copy") * F.lit(OFFSET))
        return out.drop("_copy")
    return {
        "regions": t["regions"], "card_products": t["card_products"],
        "cardholders": copies(t["cardholders"], ["cardholder_id"]),
        "accounts": copies(t["accounts"], ["account_id", "cardholder_id"]),
        "monthly_statements": copies(t["monthly_statements"], ["statement_id", "account_id"]),
    }


def main():
    sf_dir, scratch = sys.argv[1], sys.argv[2]
    args = sys.argv[3:]
    buckets = 0
    if args[:1] == ["--bucketed"]:
        buckets, args = int(args[1]), args[2:]
    factors = [int(x) for x in args] or [1, 10]
    spark = get_spark("local[8]", 8)
    base = bind_clean(spark, sf_dir)
    for factor in factors:
        root = f"{scratch}/x{factor}"
        if buckets:
            write_bucketed(replicate(base, factor), root, buckets, prefix=f"x{factor}_")
            t = read_catalog_tables(spark, f"x{factor}_")
        else:
            write_tables(replicate(base, factor), root, partition_statements_by_month=True)
            t = read_tables(spark, root)
        n_stmt = t["monthly_statements"].count()
        runs = {
            "account_current": lambda: state.account_current(t).agg(F.count(F.lit(1))).collect(),
            "risk_tier_kpis": lambda: kpis.risk_tier_kpis(state.account_current(t)).collect(),
            "risk_deciles": lambda: kpis.risk_deciles(state.account_current(t)).collect(),
            "delinquency_interaction": lambda: root_cause.delinquency_interaction(state.account_current(t)).collect(),
            "monthly_trend": lambda: trends.monthly_trend(t).collect(),
            "roll_rates": lambda: trends.roll_rates(t).collect(),
        }
        times = {}
        for name, fn in runs.items():
            fn()
            t0 = time.perf_counter()
            fn()
            times[name] = round(time.perf_counter() - t0, 3)
        print(json.dumps({"factor": factor, "bucketed": buckets, "statements": n_stmt, "times": times}), flush=True)


if __name__ == "__main__":
    main()
