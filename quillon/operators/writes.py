"""Idempotent writes: what a sink should append, and the latest state of an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def appended(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key isn't there yet, once each."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def first_wins(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """The first row of each key. An aggregate, so most rows are dropped before the shuffle."""
    return rows.groupBy(*keys).agg(F.min(F.struct(order, *values)).alias("_r")).select(*keys, "_r.*")


def latest(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_r")).select(*keys, "_r.*")
