"""Checks that raise when a table breaks what a plan relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table does not keep its contract."""


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if two rows share ``keys``."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise ContractError(f"duplicate key {bad[0].asDict()}")
    return df


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """Raises if a column holds a null."""
    counts = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    bad = [c for c in cols if counts[c]]
    if bad:
        raise ContractError(f"null in {bad}")
    return df


def covered(df: DataFrame, col: str, least: float) -> DataFrame:
    """Raises if fewer than the share ``least`` of rows have a value."""
    share = df.agg(F.avg(F.col(col).isNotNull().cast("double"))).first()[0]
    if share is not None and share < least:
        raise ContractError(f"{col}: only {share:.4f} of rows have a value")
    return df


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys that must be unique on both sides and lose no row of ``left``."""
    unique(left, *keys)
    unique(right, *keys)
    out = left.join(right, keys, how)
    if how == "inner" and left.join(right, keys, "left_anti").limit(1).collect():
        raise ContractError("rows without a partner")
    return out
