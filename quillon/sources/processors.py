"""The interface that a processor implements, and the registry that raw objects go through.

A processor says how its settings are checked and how its raw objects (processor, object, body) become rows of one shape each: payouts,
members of payouts, and payments. Each method is a DataFrame transformation; `normalised` applies every registered
processor to the rows that are its own, and objects that none knows give no row.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources import bodies as B

PAYOUT = ("processor", "payout_id", "amount", "day", "state")
MEMBER = ("processor", "payout_id", "payment_id", "amount")
PAYMENT = ("processor", "payment_id", "amount", "method", "email")


class Processor(ABC):
    """A processor's answers as rows."""

    name: str

    @abstractmethod
    def problem(self, settings: Column) -> Column:
        """What is wrong with a workspace's settings (a map), or null."""

    @abstractmethod
    def payouts(self, raw: DataFrame) -> DataFrame:
        """PAYOUT rows."""

    @abstractmethod
    def members(self, raw: DataFrame) -> DataFrame:
        """MEMBER rows: what payouts consist of."""

    @abstractmethod
    def payments(self, raw: DataFrame) -> DataFrame:
        """PAYMENT rows."""


class JsonProcessor(Processor):
    """Charges, payouts and balance lists in JSON, in cents."""

    name = "stripe"

    def problem(self, settings: Column) -> Column:
        return F.when(F.coalesce(settings["api_key"], F.lit("")).rlike("^(sk|rk)_"), None).otherwise("api_key")

    def payouts(self, raw: DataFrame) -> DataFrame:
        rows = B.payout_rows(raw.where("object = 'payout'"))
        return rows.select(F.col("id").alias("payout_id"), "amount", F.col("arrives").alias("day"), F.col("status").alias("state"))

    def members(self, raw: DataFrame) -> DataFrame:
        rows = B.balance_rows(raw.where("object = 'balance'").select(F.col("id").alias("processor_payout_id"), "body"))
        return rows.select(F.col("processor_payout_id").alias("payout_id"), F.col("id").alias("payment_id"), "amount")

    def payments(self, raw: DataFrame) -> DataFrame:
        rows = B.charge_rows(raw.where("object = 'charge'").select(F.col("id").alias("k"), "body"))
        return rows.select(F.col("k").alias("payment_id"), "amount", F.when(F.col("is_card"), "card").otherwise("bank_account").alias("method"), "email")


class GatewayProcessor(Processor):
    """Transactions and batch lists in XML; a transaction names its batch by itself."""

    name = "authorize_net"

    def problem(self, settings: Column) -> Column:
        blank = lambda c: F.coalesce(F.trim(settings[c]), F.lit("")) == ""
        return F.when(blank("login_id"), "login_id").when(blank("transaction_key"), "transaction_key")

    def payouts(self, raw: DataFrame) -> DataFrame:
        rows = B.batch_rows(raw.where("object = 'batches'").select("body"))
        return rows.select(F.col("processor_payout_id").alias("payout_id"), F.lit(None).cast("decimal(18,2)").alias("amount"), F.col("settlement_date").alias("day"), F.lit("settled").alias("state"))

    def members(self, raw: DataFrame) -> DataFrame:
        rows = B.gateway_rows(raw.where("object = 'listed'").select(F.col("id").alias("k"), "body"))
        return rows.select(F.col("batch").alias("payout_id"), F.col("k").alias("payment_id"), F.when(F.col("kind") == "refund", -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"))

    def payments(self, raw: DataFrame) -> DataFrame:
        rows = B.gateway_transactions(raw.where("object = 'transaction'").select("body"))
        return rows.select(F.col("k").cast("string").alias("payment_id"), "amount", "method", "email")


REGISTRY: dict[str, Processor] = {}


def register(processor: Processor) -> None:
    """Makes a processor known; one of the same name is replaced."""
    REGISTRY[processor.name] = processor


register(JsonProcessor())
register(GatewayProcessor())


def normalised(raw: DataFrame, what: str) -> DataFrame:
    """PAYOUT, MEMBER or PAYMENT rows (`what`: payouts, members or payments) of raw(processor, object, id, body) from all processors."""
    names = {"payouts": PAYOUT, "members": MEMBER, "payments": PAYMENT}[what]
    each = [getattr(p, what)(raw.where(F.col("processor") == n)).withColumn("processor", F.lit(n)).select(*names) for n, p in sorted(REGISTRY.items())]
    return reduce(DataFrame.unionByName, each)


def problems(workspaces: DataFrame) -> DataFrame:
    """workspaces(processor, settings) with `problem`: what is wrong with their settings; `unknown` for processors that nobody registered."""
    cases = reduce(lambda c, p: c.when(F.col("processor") == p.name, p.problem(F.col("settings"))), REGISTRY.values(), F.when(~F.col("processor").isin(*REGISTRY), "unknown"))
    return workspaces.withColumn("problem", cases)
