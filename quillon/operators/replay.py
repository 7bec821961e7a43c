"""Raw snapshots, lineage, and whether a replay gives the same facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "processor_payment_id"


def snapshot(raw: DataFrame) -> DataFrame:
    """The newest capture of each object; an aggregate, so older ones fall away before the shuffle."""
    return raw.groupBy("workspace_id", "object_type", "processor_object_id").agg(F.max(F.struct("id", "raw_json")).alias("_r")).select("workspace_id", "object_type", "processor_object_id", "_r.*")


def back(facts: DataFrame, batches: DataFrame, outcomes: DataFrame, acct: DataFrame) -> DataFrame:
    b = batches.select(F.col("k").alias("batch"), "workspace_id", "processor", "processor_payout_id")
    o = outcomes.select("workspace_id", KEY, "accounting_id")
    out = facts.join(b, ["workspace_id", "processor", "processor_payout_id"], "left").join(o, ["workspace_id", KEY], "left")
    return out.join(acct.select("accounting_id", "acct_date"), "accounting_id", "left").select(KEY, "batch", "accounting_id", "acct_date")


def key_difference(original: DataFrame, replay: DataFrame) -> DataFrame:
    missing = original.select(KEY).join(replay.select(KEY), KEY, "left_anti").withColumn("side", F.lit("missing"))
    extra = replay.select(KEY).join(original.select(KEY), KEY, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def _normal(c: Column) -> Column:
    """Numbers to two places, other text stripped, blank as null."""
    text = F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(F.bround(text.try_cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string"), text)


def keyed(facts: DataFrame) -> DataFrame:
    """facts with `rk`, the key that a replay is held against: payment id, else refund id, else payout id and kind; of several rows of a key the last."""
    rk = F.coalesce("processor_payment_id", "processor_refund_id", F.concat_ws(":", "processor_payout_id", "event_type"))
    columns = facts.columns
    return facts.groupBy(rk.alias("rk")).agg(F.max_by(F.struct(*columns), "k").alias("_r")).select("rk", "_r.*")


def _text(fields: list[str], side: str) -> Column:
    return F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(side)


def _aligned(original: DataFrame, replay: DataFrame, fields: list[str], key: str = KEY) -> DataFrame:
    side = lambda df, s: df.select(key, _text(fields, s))
    return side(original, "o").join(side(replay, "r"), key, "full_outer")


def _fields_of(fields: list[str]) -> Column:
    """Each field with its texts on both sides."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").alias("was"), F.col(f"r.{f}").alias("now")) for f in fields])


def _differ(x: Column) -> Column:
    """Whether a field differs. Most texts are the same as they stand, and only others are parsed: a text that is no number costs an exception."""
    return ~x["was"].eqNullSafe(x["now"]) & ~_normal(x["was"]).eqNullSafe(_normal(x["now"]))


def verdict(original: DataFrame, replay: DataFrame, fields: list[str], key: str = "rk") -> DataFrame:
    """One row: keys missing, extra, differing and equal, and whether the replay passed."""
    o, r = F.col("o"), F.col("r")
    both, differ = o.isNotNull() & r.isNotNull(), F.exists(_fields_of(fields), _differ)
    n = _aligned(original, replay, fields, key).agg(F.count_if(r.isNull()).alias("missing"), F.count_if(o.isNull()).alias("extra"), F.count_if(both & differ).alias("differing"), F.count_if(both & ~differ).alias("equal"))
    return n.withColumn("passed", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0))


def equivalence(original: DataFrame, replay: DataFrame, fields: list[str]) -> DataFrame:
    result = F.when(F.col("o").isNull(), "extra").when(F.col("r").isNull(), "missing").when(F.exists(_fields_of(fields), _differ), "differing").otherwise("equal")
    return _aligned(original, replay, fields).groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("n"))


def field_differences(original: DataFrame, replay: DataFrame, fields: list[str], key: str = KEY) -> DataFrame:
    """A row for each field that differs between rows present on both sides."""
    both = _aligned(original, replay, fields, key).where("o is not null and r is not null")
    return both.select(key, F.inline(F.filter(_fields_of(fields), _differ))).select(key, "field", _normal(F.col("was")).alias("was"), _normal(F.col("now")).alias("now"))


def report(original: DataFrame, replay: DataFrame, fields: list[str]) -> DataFrame:
    """By workspace: facts there were and facts that the replay made, how many are missing, extra or different, and the verdict (equivalent, differences, or failed where nothing came)."""
    side = lambda df, s: df.select(KEY, F.col("workspace_id").alias(f"w{s}"), _text(fields, s))
    both = side(original, "o").join(side(replay, "r"), KEY, "full_outer")
    o, r = F.col("o"), F.col("r")
    n = both.groupBy(F.coalesce("wo", "wr").alias("workspace_id")).agg(
        F.count("o").alias("originals"), F.count("r").alias("replayed"), F.count_if(r.isNull()).alias("missing"), F.count_if(o.isNull()).alias("extra"), F.count_if(o.isNotNull() & r.isNotNull() & F.exists(_fields_of(fields), _differ)).alias("differing"),
    )
    same = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("differing") == 0)
    return n.withColumn("verdict", F.when(same, "equivalent").when(F.col("replayed") == 0, "failed").otherwise("differences"))
