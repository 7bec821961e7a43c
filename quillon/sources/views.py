"""Settlement views over the driver's tables: processor facts, accounting facts, deposits, payout batches, raw objects, jobs.

The tables aren't processor exports, so the views derive their columns with integer arithmetic only; any
engine computes the same rows. `SQL` holds the same definitions for the oracle.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def processor_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A processor fact for each order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("k"),
        F.concat(F.lit("ws_"), (F.col("o_custkey") % 4).cast("string")).alias("workspace_id"),
        F.when(k % 2 == 0, "stripe").otherwise("authorize_net").alias("processor"),
        F.when(k % 97 == 0, "ach_return").when(k % 20 == 1, "refund").otherwise("payment").alias("event_type"),
        F.concat(F.lit("tx"), k.cast("string")).alias("processor_payment_id"),
        F.concat(F.lit("po_"), (F.col("o_custkey") % 4).cast("string"), F.lit("_"), day.cast("string")).alias("processor_payout_id"),
        (F.floor(F.col("o_totalprice") / 5000) * 5000).cast("decimal(18,2)").alias("amount_gross"),
        F.when(k % 5 == 0, "bank_account").when(k % 41 == 0, None).otherwise("card").alias("payment_method"),
        day.alias("proc_date"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com"))).alias("customer_email"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("customer_name"),
    )


def accounting_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An accounting fact for nine orders of ten, some days off, with names in several spellings and some references wrong."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").where("o_orderkey % 10 <> 9")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("o_orderkey")
    name = F.concat_ws(" ", "c_name", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("k"),
        F.concat(F.lit("ws_"), (F.col("o_custkey") % 4).cast("string")).alias("workspace_id"),
        F.when(k % 20 == 1, "refund_observed").otherwise("payment_observed").alias("event_type"),
        F.concat(F.lit("q"), k.cast("string")).alias("accounting_id"),
        F.when(k % 3 == 0, F.concat(F.lit("tx"), k.cast("string"))).when(k % 11 == 0, F.concat(F.lit("X"), k.cast("string"))).otherwise("").alias("ref_no"),
        (F.floor(F.col("o_totalprice") / 5000) * 5000).cast("decimal(18,2)").alias("amount_gross"),
        F.date_add(F.col("o_orderdate").cast("date"), ((k * 7) % 13 - 3).cast("int")).alias("acct_date"),
        F.when(k % 7 == 0, None).otherwise(F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit("@example.com"))).alias("customer_email"),
        F.when(k % 4 == 0, F.concat(F.lit("  "), F.upper(name), F.lit(" "))).when(k % 4 == 1, F.concat_ws(", ", "c_mktsegment", "c_name")).when(k % 4 == 2, F.col("c_name")).alias("customer_name"),
    )


def deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deposit for each payout of an even day: half list typed lines, half only component ids."""
    a = accounting_facts(spark, sf_dir).withColumn("payout_day", F.date_add("acct_date", (-((F.col("k") * 7) % 13 - 3)).cast("int"))).where(F.dayofmonth("payout_day") % 2 == 0)
    lines = F.array_sort(F.collect_list(F.struct("k", F.when(F.col("event_type") == "refund_observed", "RefundReceipt").otherwise("Payment").alias("txn_type"), F.col("accounting_id").alias("txn_id"), F.col("amount_gross").alias("amount"))))
    grouped = a.groupBy("workspace_id", "payout_day").agg(lines.alias("lines"), F.sum("amount_gross").cast("decimal(18,2)").alias("total_amount"))
    typed = F.dayofmonth("payout_day") % 4 == 0
    none = F.array().cast(dict(grouped.dtypes)["lines"])
    return grouped.select("workspace_id", F.concat_ws("_", F.lit("dep"), "workspace_id", F.col("payout_day").cast("string")).alias("deposit_id"), F.col("payout_day").alias("deposit_date"), "total_amount", F.when(typed, F.col("lines")).otherwise(none).alias("lines"), F.transform("lines", lambda x: x["txn_id"]).alias("component_payment_ids"))


def deposit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accounting facts that deposits hold, a row each."""
    a = accounting_facts(spark, sf_dir).withColumn("payout_day", F.date_add("acct_date", (-((F.col("k") * 7) % 13 - 3)).cast("int"))).where(F.dayofmonth("payout_day") % 2 == 0)
    return a.select(F.concat_ws("_", F.lit("dep"), "workspace_id", F.col("payout_day").cast("string")).alias("deposit_id"), "k", F.when(F.col("event_type") == "refund_observed", "RefundReceipt").otherwise("Payment").alias("txn_type"), F.col("accounting_id").alias("txn_id"), F.col("amount_gross").alias("amount"))


def payout_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each payout, with a header that is off now and then."""
    p = processor_facts(spark, sf_dir)
    grouped = p.groupBy("workspace_id", "processor", "processor_payout_id", "proc_date").agg(
        F.sum("amount_gross").cast("decimal(18,2)").alias("members_gross"), F.count(F.lit(1)).alias("payment_count"), F.min("k").alias("k"),
        F.count_if(F.col("payment_method").eqNullSafe("bank_account")).alias("n_ach"))
    gross = (F.col("members_gross") + F.when(F.col("k") % 13 == 0, 5).otherwise(0)).cast("decimal(18,2)")
    fees = (F.floor(F.col("k") % 7) * 10).cast("decimal(18,2)")
    return grouped.select("k", "workspace_id", "processor", "processor_payout_id", F.col("proc_date").alias("settlement_date"), gross.alias("gross_amount"), fees.alias("fees"),
        (gross - fees).cast("decimal(18,2)").alias("net_amount"), (F.col("payment_count") + F.when(F.col("k") % 17 == 0, 1).otherwise(0)).alias("payment_count"),
        F.when(F.col("n_ach") > 0, "ach").otherwise("card").alias("payout_type"), F.when(F.col("k") % 3 == 0, "complete").when(F.col("k") % 3 == 1, "pending").otherwise("posted").alias("status"),
        F.when(F.col("k") % 10 == 0, F.concat(F.lit("plan"), F.col("k").cast("string"))).alias("posting_plan_id"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching outcomes of four processor facts in five."""
    p = processor_facts(spark, sf_dir).where("k % 5 <> 2")
    k = F.col("k")
    return p.select("workspace_id", "processor_payment_id", "k", F.when(k % 10 != 9, F.concat(F.lit("q"), k.cast("string"))).alias("accounting_id"), F.when(k % 10 == 9, "unmatched").when(k % 4 == 0, "pending").otherwise("auto").alias("match_type"), (50 + k % 51).cast("int").alias("match_confidence"))


def raw_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured API objects: the events table, an object for each user and type, a run for each day."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("ws_"), (F.col("user_id") % 4).cast("string")).alias("workspace_id"), F.col("event_type").alias("object_type"), F.concat(F.lit("obj"), F.col("user_id").cast("string")).alias("processor_object_id"), F.to_date("ts").cast("string").alias("sync_run_id"), F.col("props").alias("raw_json"), F.col("ts").cast("timestamp").alias("captured_at"), F.col("value").alias("value"))


def sync_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each event."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "CLAIMED", "RUNNING", "COMPLETED", "FAILED", "CANCELLED", "RETRYING"))), (i % 7 + 1).cast("int"))
    return e.select(i.alias("job_id"), F.concat(F.lit("ws_"), (F.col("user_id") % 20).cast("string")).alias("workspace_id"), status.alias("status"), (i % 5).cast("int").alias("priority"), F.col("ts").cast("timestamp").alias("scheduled_at"), F.col("ts").cast("timestamp").alias("heartbeat_at"), (i % 4).cast("int").alias("retry_count"), F.lit(3).alias("max_retries"), (i % 50).alias("sync_run_id"))


def machine_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six steps for each key, minutes apart, from the events; every fifth user's ones are out of turn."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    key, pos = F.floor(i / 6), i % 6
    turn = pos + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)
    states = F.from_json(F.lit(json.dumps(TURNS)), "map<string,array<string>>")
    kind = F.element_at(F.array(*map(F.lit, TURNS)), (key % 4 + 1).cast("int"))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + key * 60 + pos * (2 + key % 13) * 60)
    return e.select(kind.alias("kind"), key.alias("id"), i.alias("seq"), at.alias("at"), F.element_at(states[kind], (turn % 6 + 1).cast("int")).alias("to_state"))


#: What the keys of each kind ask for, one after another.
TURNS = {
    "run": ["initiated", "discovering", "matching", "executing", "completed", "cancelled"],
    "job": ["QUEUED", "CLAIMED", "RUNNING", "RUNNING", "COMPLETED", "FAILED"],
    "operation": ["pending", "failed", "pending", "completed", "pending", "failed"],
    "lock": ["held", "released", "held", "held", "released", "held"],
}

#: The same for the oracle, as a relation `steps`.
STEPS_SQL = f"""steps as (select k.kind, e.id, e.seq, timestamp '2024-01-01' + interval 1 minute * (e.id + e.pos * (2 + e.id % 13)) "at", k.states[e.turn % 6 + 1] to_state
  from (select event_id // 6 id, event_id seq, event_id % 6 pos, event_id % 6 + case when user_id % 5 = 0 then 1 else 0 end turn from events) e
  join (values {", ".join(f"({n}, '{kind}', {states})" for n, (kind, states) in enumerate(TURNS.items()))}) k(n, kind, states) on k.n = e.id % 4)"""

#: The same views for the oracle, as the head of a WITH clause.
SQL = """proc as (select o_orderkey k, 'ws_' || (o_custkey % 4) workspace_id, case when o_orderkey % 2 = 0 then 'stripe' else 'authorize_net' end processor,
  case when o_orderkey % 97 = 0 then 'ach_return' when o_orderkey % 20 = 1 then 'refund' else 'payment' end event_type, 'tx' || o_orderkey processor_payment_id,
  'po_' || (o_custkey % 4) || '_' || cast(o_orderdate as date) processor_payout_id, cast(floor(o_totalprice / 5000) * 5000 as decimal(18,2)) amount_gross,
  case when o_orderkey % 5 = 0 then 'bank_account' when o_orderkey % 41 = 0 then null else 'card' end payment_method, cast(o_orderdate as date) proc_date,
  case when o_orderkey % 7 = 0 then null else lower(replace(c_name, '#', '')) || '@example.com' end customer_email, c_name || ' ' || c_mktsegment customer_name
  from orders join customer on o_custkey = c_custkey),
acct as (select o_orderkey k, 'ws_' || (o_custkey % 4) workspace_id, case when o_orderkey % 20 = 1 then 'refund_observed' else 'payment_observed' end event_type, 'q' || o_orderkey accounting_id,
  case when o_orderkey % 3 = 0 then 'tx' || o_orderkey when o_orderkey % 11 = 0 then 'X' || o_orderkey else '' end ref_no, cast(floor(o_totalprice / 5000) * 5000 as decimal(18,2)) amount_gross,
  cast(o_orderdate as date) + cast((o_orderkey * 7) % 13 - 3 as int) acct_date, cast(o_orderdate as date) payout_day,
  case when o_orderkey % 7 = 0 then null else lower(replace(c_name, '#', '')) || '@example.com' end customer_email,
  case when o_orderkey % 4 = 0 then '  ' || upper(c_name || ' ' || c_mktsegment) || ' ' when o_orderkey % 4 = 1 then c_mktsegment || ', ' || c_name when o_orderkey % 4 = 2 then c_name end customer_name
  from orders join customer on o_custkey = c_custkey where o_orderkey % 10 <> 9),
dep_lines as (select workspace_id, 'dep_' || workspace_id || '_' || payout_day deposit_id, payout_day deposit_date, k, accounting_id txn_id, amount_gross amount,
  case when event_type = 'refund_observed' then 'RefundReceipt' else 'Payment' end txn_type, day(payout_day) % 4 = 0 typed from acct where day(payout_day) % 2 = 0),
batches as (select k, workspace_id, processor, processor_payout_id, proc_date settlement_date, cast(g + case when k % 13 = 0 then 5 else 0 end as decimal(18,2)) gross_amount, cast((k % 7) * 10 as decimal(18,2)) fees,
  cast(g + case when k % 13 = 0 then 5 else 0 end - (k % 7) * 10 as decimal(18,2)) net_amount, n + case when k % 17 = 0 then 1 else 0 end payment_count, case when a > 0 then 'ach' else 'card' end payout_type,
  case k % 3 when 0 then 'complete' when 1 then 'pending' else 'posted' end status, case when k % 10 = 0 then 'plan' || k end posting_plan_id
  from (select workspace_id, processor, processor_payout_id, proc_date, sum(amount_gross) g, count(*) n, min(k) k, count(*) filter (payment_method = 'bank_account') a from proc group by all)),
outc as (select workspace_id, processor_payment_id, k, case when k % 10 <> 9 then 'q' || k end accounting_id, case when k % 10 = 9 then 'unmatched' when k % 4 = 0 then 'pending' else 'auto' end match_type,
  cast(50 + k % 51 as int) match_confidence from proc where k % 5 <> 2),
raw as (select event_id id, 'ws_' || (user_id % 4) workspace_id, event_type object_type, 'obj' || user_id processor_object_id, cast(cast(ts as date) as varchar) sync_run_id, props raw_json, ts captured_at, value from events),
jobs as (select event_id job_id, 'ws_' || (user_id % 20) workspace_id, ['QUEUED','CLAIMED','RUNNING','COMPLETED','FAILED','CANCELLED','RETRYING'][event_id % 7 + 1] status, cast(event_id % 5 as int) priority,
  ts scheduled_at, ts heartbeat_at, cast(event_id % 4 as int) retry_count, 3 max_retries, event_id % 50 sync_run_id from events)"""
