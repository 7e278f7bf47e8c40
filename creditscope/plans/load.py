"""Load gate: the declared constraints enforced on the way in (A-3, A-6).

Every row of a table either is kept or names the constraint that it breaks, as a
row-by-row insert with skipped failures would: a row that breaks another constraint
does not take its key, and a foreign key must name a kept parent.  Constraints are
tried in the order NOT NULL, CHECK, foreign key, primary key, each kind as declared.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditscope.plans.clean import with_existence
from creditscope.schema import CONSTRAINTS, LOAD_ORDER, TABLES
from creditscope.session import freeze
from creditscope.sources.files import exists, rename
from creditscope.sources.io import write_table

Tables = dict[str, DataFrame]

#: How many equal rows a judged row stands for, and the constraint it breaks (NULL: kept).
COPIES, BROKEN = "copies", "constraint_name"
LOADED = "loaded"


def _first_broken(tests: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in tests], F.lit(None).cast("string"))


def judge(df: DataFrame, table: str, kept_parents: Tables) -> DataFrame:
    """Distinct rows of ``df`` with ``copies`` and the constraint they break.

    Of the sound rows with one key the smallest in column order (NULLs first) is kept,
    once; its further copies and the key's other rows break the primary key.  Equal
    rows are combined before any shuffle, and the least row of a key is an aggregate, so
    neither many copies nor many rows of one key gather in a task; the join back to a
    key's first row has one row per key on one side.  NULL foreign keys are the NOT NULL
    constraint's matter, a NULL passes a CHECK, as in SQL."""
    cols = TABLES[table].fieldNames()
    declared = [c for c in CONSTRAINTS if c.table == table]
    rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias(COPIES))
    tests = [(c.name, F.col(c.column).isNull()) for c in declared if c.kind == "not_null"]
    tests += [(c.name, ~F.coalesce(F.expr(c.sql), F.lit(True))) for c in declared if c.kind == "check"]
    for c in declared:
        if c.kind == "fk":
            found = f"_found_{c.column}"
            rows = with_existence(rows, found, **{c.column: kept_parents[c.ref_table].select(c.ref_column)})
            tests.append((c.name, F.col(c.column).isNotNull() & ~F.col(found)))
    judged = rows.select(*cols, COPIES, _first_broken(tests).alias(BROKEN))
    pk = next(c for c in declared if c.kind == "pk")
    whole = F.struct(*cols)
    firsts = judged.where(F.col(BROKEN).isNull()).groupBy(F.col(pk.column).alias("_key")).agg(F.min(whole).alias("_first"))
    # Rows that break something else find no first row of their own and stay as they are.
    placed = judged.join(firsts, F.col(BROKEN).isNull() & (F.col(pk.column) == F.col("_key")), "left")
    is_first = F.col("_first").isNotNull() & whole.eqNullSafe(F.col("_first"))
    sound = F.col(BROKEN).isNull()
    kept = F.struct(F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("why"))
    surplus = F.struct(F.when(is_first, F.col(COPIES) - 1).otherwise(F.col(COPIES)).alias("n"), F.lit(pk.name).alias("why"))
    other = F.struct(F.col(COPIES).alias("n"), F.col(BROKEN).alias("why"))
    parts = F.when(~sound, F.array(other)).when(is_first, F.array(kept, surplus)).otherwise(F.array(surplus))
    return (placed.withColumn("_part", F.explode(parts)).where("_part.n > 0")
            .select(*cols, F.col("_part.n").alias(COPIES), F.col("_part.why").alias(BROKEN)))


def gate(t: Tables) -> Tables:
    """Every table judged, parents first, each checkpointed: its kept rows, its rejected
    rows, the report and its children read the same verdicts."""
    judged: Tables = {}
    for name in LOAD_ORDER:
        judged[name] = freeze(judge(t[name], name, {p: kept_rows(df, p) for p, df in judged.items()}))
    return judged


def kept_rows(judged: DataFrame, table: str) -> DataFrame:
    return judged.where(F.col(BROKEN).isNull()).select(*TABLES[table].fieldNames())


def rejected_rows(judged: DataFrame) -> DataFrame:
    """The rows that stay out, once each, with the number of copies and the constraint."""
    return judged.where(F.col(BROKEN).isNotNull())


def load_report(judged: Tables) -> DataFrame:
    """(table_name, outcome, rows, key_sum): kept rows under ``loaded``, the others under
    the constraint that they break; the sum of the keys tells which rows."""
    parts = []
    for name, df in judged.items():
        key = TABLES[name].fieldNames()[0]
        parts.append(df.groupBy(F.coalesce(F.col(BROKEN), F.lit(LOADED)).alias("outcome")).agg(
            F.sum(COPIES).alias("rows"), F.sum(F.col(key).cast("long") * F.col(COPIES)).alias("key_sum"))
            .select(F.lit(name).alias("table_name"), "outcome", "rows", "key_sum"))
    return reduce(DataFrame.unionByName, parts)


def publish(t: Tables, root: str, name: str = "current", fmt: str = "parquet") -> Tables:
    """Loads the tables through the gate to ``root/name``: ``<table>`` holds the kept rows,
    ``rejected/<table>`` the others.  All is written beside it first and appears under
    its name by one rename, so a reader sees a whole load or none (on file systems that
    rename folders at once).  An existing load of that name is not replaced."""
    target = f"{root}/{name}"
    spark = t["regions"].sparkSession
    if exists(spark, target):
        raise FileExistsError(f"{target}: loads are not replaced")
    staged = f"{root}/_loading-{uuid.uuid4().hex}"
    judged = gate(t)
    for table, df in judged.items():
        write_table(kept_rows(df, table), staged, table, fmt)
        write_table(rejected_rows(df), f"{staged}/rejected", table, fmt)
    rename(spark, staged, target)
    return judged
