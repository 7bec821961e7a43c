"""Contract, schema and immutability checks, and timers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df's rows once for each rule that holds against them, named in `problem`."""
    return df.withColumn("problem", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))))


def schema_findings(df: DataFrame, wanted: set[str]) -> DataFrame:
    found = set(df.columns)
    rows = [(c, "missing") for c in sorted(wanted - found)] + [(c, "unexpected") for c in sorted(found - wanted)]
    return df.sparkSession.createDataFrame(rows, "column_name string, finding string")


def changed(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose content isn't what it was; only key and hash are shuffled."""
    digest = lambda df, name: df.select(key, F.xxhash64(*fields).alias(name))
    return digest(before, "_a").join(digest(after, "_b"), key).where("_a <> _b").select(key)


def expired(events: DataFrame, kind: str, minutes: int) -> DataFrame:
    """Events of a kind that no event of the user follows within `minutes`."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    late = F.col("next_ts").isNull() | (F.col("next_ts") > F.col("ts") + F.expr(f"interval {minutes} minutes"))
    return events.withColumn("next_ts", F.lead("ts").over(w)).where((F.col("event_type") == kind) & late).select("user_id", F.col("event_id").alias("started"))
