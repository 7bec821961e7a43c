"""Which batches may explain a deposit of bank transfers, scored and ranked; nothing is matched by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.operators.posting import KEYS

WINDOW_DAYS = 14


def window(deposits: DataFrame, batches: DataFrame) -> DataFrame:
    """Pairs of a deposit and a batch settled on its day or within 14 days before, with amount and date scores.

    Days are cut into spans of 15: a batch is posted in its span and the next, so the range condition
    becomes an equi-join on workspace and span, and each pair meets once.
    """
    span = lambda day: F.floor(F.unix_date(day) / (WINDOW_DAYS + 1))
    b = batches.where("payout_type = 'ach'").select("k", "workspace_id", "processor_payout_id", "settlement_date", "gross_amount").withColumn("span", F.explode(F.array(span(F.col("settlement_date")), span(F.col("settlement_date")) + 1)))
    pairs = deposits.select("workspace_id", "deposit_id", "deposit_date", "total_amount").withColumn("span", span(F.col("deposit_date"))).join(b, ["workspace_id", "span"]).where(F.col("settlement_date").between(F.date_sub("deposit_date", WINDOW_DAYS), F.col("deposit_date")))
    out = pairs.withColumn("days", F.datediff("deposit_date", "settlement_date")).withColumn("fee", (F.col("gross_amount") - F.col("total_amount")).cast("double"))
    return out.withColumn("amount_score", S.fee_points(F.col("fee"))).withColumn("date_score", S.lag_points(F.col("days")))


def members(batches: DataFrame, proc: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per batch: the share of e-mails and names present, in percent, and whether it has payments and all are matched."""
    o = outcomes.select("workspace_id", "processor_payment_id", "accounting_id")
    m = batches.select("k", *KEYS).join(proc.drop("k"), KEYS).join(o, ["workspace_id", "processor_payment_id"], "left")
    present = lambda c: F.count(S.blank_to_null(F.col(c)))
    payment = F.col("event_type") == "payment"
    return m.groupBy("k").agg((100.0 * (present("customer_email") + present("customer_name")) / (2 * F.count(F.lit(1)))).alias("identity"), ((F.count_if(payment) > 0) & (F.count_if(payment & F.col("accounting_id").isNull()) == 0)).alias("eligible"))


def band(batches: DataFrame, width: int = 15) -> DataFrame:
    """Per batch the number of batches of the workspace whose gross is within `width`, itself included.

    Amounts are counted first and cut into cells of `width`; each meets those of its own cell and the two
    beside it in an equi-join, so no task holds a workspace.
    """
    ach = batches.where("payout_type = 'ach'")
    cell = F.floor(F.col("gross_amount") / width).cast("long")
    amounts = ach.groupBy("workspace_id", "gross_amount").agg(F.count(F.lit(1)).alias("_c"))
    near = amounts.select("workspace_id", F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.col("gross_amount").alias("_other"), "_c")
    pairs = amounts.select("workspace_id", cell.alias("_cell"), "gross_amount").join(near, ["workspace_id", "_cell"]).where(F.abs(F.col("gross_amount") - F.col("_other")) <= width)
    return ach.join(pairs.groupBy("workspace_id", "gross_amount").agg(F.sum("_c").alias("n")), ["workspace_id", "gross_amount"])


def ranked(deposits: DataFrame, batches: DataFrame, proc: DataFrame, outcomes: DataFrame, explains: Column | None = None) -> DataFrame:
    """The batches that may explain a deposit, ranked. explains: which batches take part (open ones that are marked as bank transfers); the band counts all the same."""
    some = batches if explains is None else batches.where(explains)
    parts = window(deposits, some).join(members(some, proc, outcomes), "k").join(band(batches).select("k", S.rarity_points(F.col("n")).alias("uniqueness")), "k")
    score = F.round(0.7 * F.col("amount_score") + 0.15 * F.col("date_score") + 0.1 * F.col("identity") + 0.05 * F.col("uniqueness"), 6)
    rank = F.row_number().over(Window.partitionBy("deposit_id").orderBy(F.col("eligible").desc(), F.col("score").desc(), "k"))
    return parts.withColumn("score", score).withColumn("rank", rank).select("deposit_id", "k", "eligible", "score", "rank")


def review_items(ranked_: DataFrame) -> DataFrame:
    """An item to review for each deposit that has candidates: their number, the best, and all of them in order. They are the batches of a workspace and fifteen days."""
    items = ranked_.groupBy("deposit_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if("eligible").alias("n_eligible"), F.array_sort(F.collect_list(F.struct("rank", "k"))).alias("_c"))
    return items.select("deposit_id", F.lit("pending").alias("status"), "n_candidates", "n_eligible", F.col("_c")[0]["k"].alias("best"), F.array_join(F.transform("_c", lambda c: c["k"].cast("string")), ",").alias("candidates"))
