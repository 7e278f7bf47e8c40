"""Readers and writers (A-1..A-4, A-7..A-10).

Raw exports are read all-string and by header name; the input position (file,
split, row) is attached at the scan, before any shuffle, for "first row wins"
rules.  Sinks write Parquet by default; CSV output writes ISO dates.
Extract and report sinks are for aggregates only (a handful of rows), which
is why they may write a single file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditscope.functions.exprs import null_tokens_to_null
from creditscope.plans.clean import POS
from creditscope.schema import LOAD_ORDER, TABLES, raw_schema
from creditscope.sources.files import name_single_part


def read_raw(spark: SparkSession, path: str, table: str, multi_line: bool = False) -> DataFrame:
    """All-string CSV scan; missing-value tokens become NULL.

    Columns are taken by header name, whatever their order; every file must have the
    first one's header.  Quotes inside quotes are doubled.  A row with too many or
    too few fields raises.  ``multi_line`` allows line breaks inside quotes; such
    files cannot be split, so it is off unless asked for (a broken row then raises).
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).schema
    df = spark.read.schema(header).options(**options, enforceSchema=False).csv(path)
    wanted = raw_schema(table).fieldNames()
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id().alias("row"))
    return df.select(*[null_tokens_to_null(F.col(c)).alias(c) for c in wanted], place.alias(POS))


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    """Typed read of a clean table with its declared schema."""
    reader = spark.read.schema(TABLES[table])
    if fmt == "csv":
        return reader.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return reader.parquet(path)


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {t: read_table(spark, f"{root}/{t}", t, fmt) for t in LOAD_ORDER}


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet",
                 partition_statements_by_month: bool = False) -> None:
    """Write the clean tables parents-first.  Statements may be partitioned by
    month so period filters prune files."""
    for name in LOAD_ORDER:
        write_table(tables[name], root, name, fmt, partition_statements_by_month)


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", by_month: bool = False) -> None:
    """One clean table at ``root/name``."""
    w = df.write.mode("overwrite")
    if name == "monthly_statements" and by_month:
        w = w.partitionBy("statement_month")
    if fmt == "csv":
        w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{root}/{name}")
    else:
        w.parquet(f"{root}/{name}")


def write_extracts(extracts: dict[str, DataFrame], root: str) -> None:
    """Small BI extracts as single headed CSV files (aggregates only)."""
    for name, df in extracts.items():
        (df.coalesce(1).write.mode("overwrite").option("header", True)
         .option("dateFormat", "yyyy-MM-dd").csv(f"{root}/{name}"))


def write_named_extracts(extracts: dict[str, DataFrame], root: str) -> None:
    """The extracts as files ``root/<name>.csv``: each is written beside its place and gets
    its name by a rename when it is whole, in place of an older one."""
    for name, df in extracts.items():
        write_extracts({f"_writing-{name}": df}, root)
        name_single_part(df.sparkSession, f"{root}/_writing-{name}", f"{root}/{name}.csv", ".csv")


def write_json(df: DataFrame, path: str) -> None:
    """A small result (audit, findings) as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


# Tables keyed by account: bucketed alike so their joins and per-account
# windows need no shuffle of the statement panel.
ACCOUNT_BUCKETED = ("accounts", "monthly_statements")


def write_bucketed(tables: dict[str, DataFrame], root: str, buckets: int, prefix: str = "") -> None:
    """Save the clean tables as catalog tables at ``root/<name>``; accounts and
    statements bucketed and sorted by account_id into ``buckets`` buckets."""
    for name in LOAD_ORDER:
        w = tables[name].write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
        if name in ACCOUNT_BUCKETED:
            w = w.bucketBy(buckets, "account_id").sortBy("account_id")
        w.saveAsTable(f"{prefix}{name}")


def read_catalog_tables(spark: SparkSession, prefix: str = "") -> dict[str, DataFrame]:
    return {name: spark.table(f"{prefix}{name}") for name in LOAD_ORDER}
