"""Data-quality audit, declared-constraint report and row counts (Q-22, Q-23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditscope.plans.clean import CHECK_ORDER, clean_all
from creditscope.schema import CONSTRAINTS, LOAD_ORDER

Tables = dict[str, DataFrame]


def _ordinal(table_col: str, check_col: str):
    expr = None
    i = 0
    for table in LOAD_ORDER:
        for check in CHECK_ORDER[table]:
            cond = (F.col(table_col) == table) & (F.col(check_col) == check)
            expr = F.when(cond, i) if expr is None else expr.when(cond, i)
            i += 1
    return expr.otherwise(i)


def quality_report(raw: Tables, median_method: str = "exact") -> DataFrame:
    """(table_name, check_name, cnt): every repair the cleaning step made."""
    return ordered_audit(clean_all(raw, median_method).audit)


def ordered_audit(audit: DataFrame) -> DataFrame:
    return audit.orderBy(_ordinal("table_name", "check_name")).select("table_name", "check_name", "cnt")


def check_constraints(t: Tables) -> DataFrame:
    """(table_name, constraint_name, violations) for every declared PK, NOT
    NULL, CHECK and FK.  NOT NULL and CHECK counts come from one aggregate per
    table; CHECK passes on NULL and a NULL foreign key is not an FK violation,
    as in SQL.  PK violations are the surplus rows of repeated or NULL keys."""
    parts: list[DataFrame] = []
    for table in LOAD_ORDER:
        df = t[table]
        cons = [c for c in CONSTRAINTS if c.table == table]
        simple = [c for c in cons if c.kind in ("not_null", "check")]
        if simple:
            aggs = []
            for c in simple:
                bad = F.col(c.column).isNull() if c.kind == "not_null" else \
                    ~F.coalesce(F.expr(c.sql), F.lit(True))
                aggs.append(F.count_if(bad).alias(c.name))
            pairs = ", ".join(f"'{c.name}', `{c.name}`" for c in simple)
            parts.append(df.agg(*aggs).selectExpr(f"stack({len(simple)}, {pairs}) as (constraint_name, violations)")
                         .select(F.lit(table).alias("table_name"), "constraint_name", "violations"))
        for c in cons:
            if c.kind == "pk":
                per_key = df.groupBy(c.column).agg(F.count(F.lit(1)).alias("_n"))
                bad = F.when(F.col(c.column).isNull(), F.col("_n")).otherwise(F.col("_n") - 1)
                v = per_key.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("violations"))
            elif c.kind == "fk":
                parent = t[c.ref_table].select(F.col(c.ref_column).alias(c.column)).distinct()
                missing = df.filter(F.col(c.column).isNotNull()).join(parent, c.column, "left_anti")
                v = missing.agg(F.count(F.lit(1)).alias("violations"))
            else:
                continue
            parts.append(v.select(F.lit(table).alias("table_name"), F.lit(c.name).alias("constraint_name"),
                                  F.col("violations").cast("bigint").alias("violations")))
    return reduce(DataFrame.unionByName, parts)


def table_counts(t: Tables) -> DataFrame:
    """(table_name, rows) for the five tables, ordered by name."""
    parts = [t[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
             for name in LOAD_ORDER]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")
