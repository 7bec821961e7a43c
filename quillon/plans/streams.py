"""Structured Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import observed as O
from quillon.plans.catalogue import query
from quillon.sources import views as V
from quillon.sources.scratch import folder_of
from quillon.streaming import healing as H
from quillon.streaming import ingest as I
from quillon.streaming import machines as M


def _events(spark, d):
    schema = V.table(spark, d, "events").schema
    return I.source(spark, f"{d}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_id, user_id, event_type from events", head=False)
def stream_ingest_dedup(spark, d):
    """Events twice over, once each in the table."""
    e, folder = _events(spark, d), folder_of(spark)
    I.drained(e.union(e).select("event_id", "user_id", "event_type", "ts"), I.merge_into(f"{folder}/table", ["event_id"], "ts"), folder)
    return spark.read.parquet(f"{folder}/table").select("event_id", "user_id", "event_type")


_HEAL = """named as (select distinct txn_id from dep_lines where typed and txn_type = 'RefundReceipt'),
r as (select accounting_id, amount_gross amount, acct_date from acct where event_type = 'refund_observed' and (acct_date >= date '1996-01-01' or accounting_id in (select txn_id from named)))"""


@query(f", {_HEAL} select * from r")
def stream_self_healing(spark, d):
    """Refunds of a sync window, and of those before it the ones that deposits name: each batch of deposits reads them from the raw store. The deposits come twice over."""
    folder = folder_of(spark, "healing")
    raw = lambda: V.accounting_facts(spark, d).where("event_type = 'refund_observed'").select("accounting_id", F.col("amount_gross").alias("amount"), "acct_date")
    raw().where("acct_date >= date '1996-01-01'").write.parquet(f"{folder}/refunds")
    deposits = V.deposits(spark, d).select("deposit_id", "lines")
    for _ in range(2):
        deposits.repartition(3).write.mode("append").parquet(f"{folder}/deposits")
    stream = spark.readStream.schema(deposits.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/deposits")
    I.drained(stream, H.heal_from(raw, f"{folder}/refunds"), folder)
    return spark.read.parquet(f"{folder}/refunds")


@query("select count(*) seen, count(*) filter (event_type = 'error') errors, cast(sum(event_id) as bigint) id_sum from events", head=False)
def stream_observed(spark, d):
    """Counters of a stream's batches, observed as they are written."""
    folder = folder_of(spark, "observed")
    e = _events(spark, d).select("event_id", "event_type").observe("ingest", F.count(F.lit(1)).alias("seen"), F.count_if(F.col("event_type") == "error").alias("errors"), F.sum("event_id").alias("id_sum"))
    query = e.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.createDataFrame([tuple(O.totals(query, "ingest").get(n, 0) for n in ("seen", "errors", "id_sum"))], "seen long, errors long, id_sum long")


@query("select event_type, max(ts) as cursor, count(*) n from events group by 1", head=False)
def stream_cursor(spark, d):
    folder = folder_of(spark)
    I.drained(_events(spark, d).select("event_id", "event_type", "ts"), I.merge_into(f"{folder}/table", ["event_id"], "ts"), folder)
    return I.cursor(spark.read.parquet(f"{folder}/table"), ["event_type"], "ts")


@query("select event_id, event_type = 'error' late from events", head=False)
def stream_late_backfill(spark, d):
    """Rows that the first pass didn't see are found by an anti-join and merged by a second."""
    folder = folder_of(spark)
    rows = _events(spark, d).select("event_id", (F.col("event_type") == "error").alias("late"), "ts")
    I.drained(rows.where("not late"), I.merge_into(f"{folder}/table", ["event_id"], "ts"), f"{folder}/first")
    I.drained(rows, I.merge_into(f"{folder}/table", ["event_id"], "ts"), f"{folder}/second")
    return spark.read.parquet(f"{folder}/table").select("event_id", "late")


#: Batches of steps that the machine queries read one after another, and steps that a file of a batch may hold.
STEP_BATCHES, STEP_ROWS = 5, 50_000


def _step_files(spark, d, folder):
    """Steps in batches by time, each step up to forty minutes out of its turn, and at last a clock row a day later, which lets every timer fire; gives the number of files of a batch.

    A batch must be read as a whole, as what comes after it moves the watermark on; so all have the same number of files, which grows with the table.
    """
    steps = V.machine_steps(spark, d)
    late = F.col("at") + F.make_dt_interval(mins=F.col("seq") % 3 * 20)
    span = steps.agg(F.min(late).alias("a"), F.max(late).alias("b"), F.max("at").alias("end")).first()
    edges = [span.a + (span.b - span.a) * i / STEP_BATCHES for i in range(STEP_BATCHES)]
    number = sum((late >= F.lit(edge)).cast("int") for edge in edges)
    files = max(1, min(r["count"] for r in steps.groupBy(number).count().collect()) // STEP_ROWS)  # the smallest batch fills them all
    for i in range(1, STEP_BATCHES + 1):
        batch = steps.where(number == i)
        (batch.coalesce(1) if files == 1 else batch.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    clock = spark.range(1).select(F.lit("clock").alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit(-1).cast("long").alias("seq"), (F.lit(span.end) + F.expr("interval 1 day")).alias("at"), F.lit("tick").alias("to_state"))
    clock.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return files


def _machine_rows(spark, d):
    folder = folder_of(spark, "machines")
    files = _step_files(spark, d, folder)
    M.started(spark.readStream.schema(M.STEPS).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder).awaitTermination()
    return M.results(spark, folder)


_FOLD = f"with recursive {V.STEPS_SQL}, {M.sql('steps')}"


@query(_FOLD + " select * from folded", head=False)
def stream_machines(spark, d):
    """Runs, jobs, operations and locks folded as their steps arrive, with illegal steps and what timers ended."""
    return _machine_rows(spark, d)


@query(_FOLD + ", ok as (select * from folded where verdict <> 'illegal') select kind, id, to_state state, verdict = 'expired' by_timer from ok qualify row_number() over (partition by kind, id order by \"at\" desc, coalesce(seq, -1) desc) = 1", head=False)
def stream_machine_states(spark, d):
    """The state that each key ends in, and whether a timer put it there."""
    return M.latest(_machine_rows(spark, d))


@query(_FOLD + " select kind, from_state, to_state, count(*) n from folded where verdict = 'expired' group by all", head=False)
def stream_timeouts(spark, d):
    """What timers ended: pending operations of 30 minutes, jobs without a heartbeat for 5, locks of 60, runs by phase and in all."""
    return _machine_rows(spark, d).where("verdict = 'expired'").groupBy("kind", "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
