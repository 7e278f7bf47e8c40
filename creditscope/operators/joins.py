"""Key-set semi / anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_referenced(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Rows whose ``key`` exists in ``parent`` (NULL keys are dropped)."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.join(p, key, "left_semi").select(*df.columns)


def orphans(df: DataFrame, key: str, parent: DataFrame, parent_key: str | None = None) -> DataFrame:
    """Rows whose ``key`` is NULL or missing from ``parent``."""
    p = parent.select(F.col(parent_key or key).alias(key)).distinct()
    return df.join(p, key, "left_anti").select(*df.columns)
