"""End-to-end runs matching the analysed pipeline's two stages.

  cleaning:  raw CSV exports -> clean tables (Parquet or CSV) + audit JSON
  analytics: clean tables    -> dashboard extracts, headline KPIs JSON,
                                scored account sample

Usage:
  python -m creditscope.pipeline clean <raw_dir> <out_dir> [--csv]
  python -m creditscope.pipeline analytics <clean_dir> <out_dir> [--csv]

Raw files are ``<raw_dir>/<table>.csv`` (a folder of part files works too).
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from creditscope.config import PortfolioConfig
from creditscope.plans import decision, models, quality, state
from creditscope.plans.clean import clean_and_write
from creditscope.schema import LOAD_ORDER
from creditscope.session import freeze, get_spark
from creditscope.sources.io import read_raw, read_table, read_tables, write_json, write_named_extracts, write_table


def run_cleaning(spark: SparkSession, raw_dir: str, out_dir: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """Clean every raw export, write the clean tables (parents first) and the audit, which
    is counted while they are written; returns the clean tables as written."""
    raw = {name: read_raw(spark, f"{raw_dir}/{name}.csv", name) for name in LOAD_ORDER}
    root = f"{out_dir}/processed"

    def write(name: str, rows: DataFrame) -> DataFrame:
        write_table(rows, root, name, fmt)
        return read_table(spark, f"{root}/{name}", name, fmt)

    audit = clean_and_write(raw, write)
    write_json(quality.ordered_audit(audit), f"{out_dir}/reports/data_quality_report")
    return read_tables(spark, root, fmt=fmt)


def run_analytics(spark: SparkSession, clean_dir: str, out_dir: str, fmt: str = "parquet",
                  cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """Dashboard extracts, the headline KPI record and the scored sample;
    returns the headline record."""
    t = read_tables(spark, clean_dir, fmt=fmt)
    # Every analysis below starts from the current state: derive it once, reliably.
    cur = freeze(state.account_current(t, cfg))
    drivers = freeze(models.delinquency_drivers(cur))
    segments = models.behavior_segments(cur, cfg=cfg)
    write_named_extracts(decision.extracts(t, cur, cfg, segments=segments, drivers=drivers), f"{out_dir}/extracts")
    write_named_extracts({"account_scored_sample": decision.scored_sample(cur, cfg=cfg)}, f"{out_dir}/extracts")
    findings = decision.headline_findings(t, cur, drivers=drivers, cfg=cfg)
    write_json(findings, f"{out_dir}/reports/kpis")
    return findings


def main(argv: list[str]) -> None:
    if len(argv) < 3 or argv[0] not in ("clean", "analytics"):
        print(__doc__)
        raise SystemExit(2)
    fmt = "csv" if "--csv" in argv else "parquet"
    spark = get_spark()
    if argv[0] == "clean":
        run_cleaning(spark, argv[1], argv[2], fmt)
    else:
        run_analytics(spark, argv[1], argv[2], fmt)


if __name__ == "__main__":
    main(sys.argv[1:])
