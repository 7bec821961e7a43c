"""Payout totals, readiness and balanced posting plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["workspace_id", "processor", "processor_payout_id"]


def totals(proc: DataFrame) -> DataFrame:
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("amount_gross")).otherwise(0)
    return proc.groupBy("processor_payout_id").agg(F.sum(of("payment")).alias("gross"), F.sum(of("refund")).alias("refunds"), F.sum(of("payment") - of("refund")).alias("net"), F.count(F.lit(1)).alias("n"))


def readiness(batches: DataFrame, proc: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Batches with counts of members, matched members and pending ones."""
    o = outcomes.select("workspace_id", "processor_payment_id", "accounting_id", "match_type")
    members = proc.join(o, ["workspace_id", "processor_payment_id"], "left").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count("accounting_id").alias("matched"), F.count_if(F.col("match_type") == "pending").alias("pending"))
    return batches.join(members, KEYS)


def lines(batches: DataFrame, proc: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The lines of each batch's plan: members with their sign (one pass over the facts) and the fee."""
    o = outcomes.select("workspace_id", "processor_payment_id", "accounting_id")
    m = batches.select("k", *KEYS).join(proc.drop("k"), KEYS).join(o, ["workspace_id", "processor_payment_id"], "left")
    kind, matched = F.col("event_type"), F.col("accounting_id").isNotNull()
    name = F.when(kind == "payment", "payment").when((kind == "refund") & matched, "refund").when(kind == "refund", "refund_account").when(kind == "ach_return", "return")
    sign = F.when(kind == "payment", F.col("amount_gross")).otherwise(-F.col("amount_gross")).cast("decimal(18,2)")
    members = m.where(name.isNotNull()).select("k", name.alias("kind"), sign.alias("amount"), F.when(kind != "ach_return", F.col("accounting_id")).alias("linked"))
    fees = batches.where("fees > 0").select("k", F.lit("fee").alias("kind"), (-F.col("fees")).cast("decimal(18,2)").alias("amount"), F.lit(None).cast("string").alias("linked"))
    return members.unionByName(fees)


def bank_lines(batches: DataFrame, members: DataFrame) -> DataFrame:
    """The lines of bank-transfer batches' plans: their members' lines, the fee that the user confirmed (ach_fees), and where the deposit that they
    expect (expected_deposit, or null) is another sum, a line that makes up the difference on the settlement account."""
    known = batches.select("k", F.col("ach_fees").cast("decimal(18,2)").alias("ach_fees"), F.col("expected_deposit").cast("decimal(18,2)").alias("expected"))
    none = F.lit(None).cast("string").alias("linked")
    own = members.where("kind <> 'fee'").join(known.select("k"), "k", "left_semi")
    fees = known.where("ach_fees > 0").select("k", F.lit("ach_fee").alias("kind"), (-F.col("ach_fees")).cast("decimal(18,2)").alias("amount"), none)
    both = own.unionByName(fees)
    off = (F.col("expected") - F.coalesce("total", F.lit(0))).cast("decimal(18,2)")
    change = known.where("expected is not null").join(both.groupBy("k").agg(F.sum("amount").alias("total")), "k", "left").select("k", F.lit("settlement_change").alias("kind"), off.alias("amount"), none).where("abs(amount) > 0.001")
    return both.unionByName(change)


def plans(lines: DataFrame, batches: DataFrame) -> DataFrame:
    """Each plan's lines and total, and how far it is from the batch's net."""
    sums = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").alias("total"))
    return sums.join(batches.select("k", "net_amount"), "k").withColumn("off", F.col("total") - F.col("net_amount"))


def unbalanced(batches: DataFrame) -> DataFrame:
    """Headers (gross_amount, fees, refunds, net) that don't add up, with how far they are off."""
    off = (F.col("gross_amount") - F.col("fees") - F.col("refunds") - F.col("net")).cast("decimal(18,2)")
    return batches.withColumn("off", off).where("abs(off) >= 0.01")


def component_checks() -> list[Column]:
    """Over a header with the sums of its components (payments, refunds, fees): whether each is its total, to less than a cent; without fee details, null, fees are right."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) < 0.01
    return [near("payments", "gross_amount").alias("payments_valid"), near("refunds", "refund_amount").alias("refunds_valid"), F.coalesce(near("fees", "fee_amount"), F.lit(True)).alias("fees_valid")]
