"""Guards, gates, invariants, counters, starts of streams, and a replay's verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators import control as C
from quillon.operators import observed as O
from quillon.operators import posting as P
from quillon.operators import replay as R
from quillon.plans.catalogue import query
from quillon.sources import views as V
from quillon.sources.scratch import folder_of

NOW = "2024-01-20 12:00:00"


@query("select b.k, count(*) filter (p.event_type = 'payment' and o.accounting_id is null) unmatched, count(*) filter (p.event_type = 'payment' and o.accounting_id is null) = 0 and (b.k % 4 <> 0 or count(*) filter (p.event_type = 'refund') = 0) may_post from batches b join proc p using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) group by b.k")
def posting_guards(spark, d):
    """Whether a batch may be posted: every payment has a match, and refunds have an account (every fourth batch here has none set)."""
    o = V.outcomes(spark, d).select("workspace_id", "processor_payment_id", "accounting_id")
    m = V.payout_batches(spark, d).select("k", *P.KEYS).join(V.processor_facts(spark, d).drop("k"), P.KEYS).join(o, ["workspace_id", "processor_payment_id"], "left")
    g = m.groupBy("k").agg(F.count_if((F.col("event_type") == "payment") & F.col("accounting_id").isNull()).alias("unmatched"), F.count_if(F.col("event_type") == "refund").alias("refunds"))
    return g.select("k", "unmatched", ((F.col("unmatched") == 0) & ((F.col("k") % 4 != 0) | (F.col("refunds") == 0))).alias("may_post"))


@query("select processor_payout_id, count(*) n, sum(amount_gross) settled from proc where k % 7 in (0, 1) group by 1")
def settled_only(spark, d):
    """Gateway rows of settled states alone, by batch."""
    names = ("settledSuccessfully", "refundSettledSuccessfully", "returnedItem", "chargeback", "voided", "expired", "neverHeardOf")
    p = V.processor_facts(spark, d).withColumn("state", F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 7 + 1).cast("int")))
    return p.where(F.col("state").isin(*labels.SETTLED)).groupBy("processor_payout_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_gross").alias("settled"))


@query("select event_id from events where json_extract_string(props, '$.k') = '7'", head=False)
def metadata_point_lookup(spark, d):
    """Rows by a key inside their JSON metadata."""
    return V.table(spark, d, "events").where(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("select 'outcome' kind, processor_payment_id subject from outc where (workspace_id, processor_payment_id) not in (select (workspace_id, processor_payment_id) from proc where k % 40 <> 0) union all select 'fact', processor_payment_id from proc where k % 40 <> 0 and (workspace_id, processor, processor_payout_id) not in (select (workspace_id, processor, processor_payout_id) from batches where k % 25 <> 0)")
def orphan_checks(spark, d):
    """Outcomes without their fact, and facts without their batch, where some of either were lost."""
    p, o = V.processor_facts(spark, d).where("k % 40 <> 0"), V.outcomes(spark, d)
    b = V.payout_batches(spark, d).where("k % 25 <> 0")
    lost = o.join(p, ["workspace_id", "processor_payment_id"], "left_anti").select(F.lit("outcome").alias("kind"), F.col("processor_payment_id").alias("subject"))
    return lost.union(p.join(b, P.KEYS, "left_anti").select(F.lit("fact"), "processor_payment_id"))


_GATES = f"""select c_custkey, case when c_acctbal <= 0 then 'licence_status' when c_custkey % 11 = 0 then 'licence_expired' when n_orders is null then 'no_credentials' when n_orders % 9 >= 5 then 'refresh_failures'
when c_custkey % 13 = 0 then 'running' when coalesce(n_open, 0) > 8 then 'active_jobs' when c_custkey % 17 = 0 then 'cooldown' when c_custkey % 19 = 0 then 'gated' else 'open' end gate
from customer left join (select o_custkey, count(*) n_orders, count(*) filter (o_orderstatus = 'O') n_open from orders group by 1) on o_custkey = c_custkey"""


@query(_GATES, head=False)
def gate_snapshot(spark, d):
    """The first gate closed for each workspace, in their order, from workspace, licence, credentials and jobs joined once."""
    c = V.table(spark, d, "customer")
    o = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    k, now = F.col("c_custkey"), F.lit(NOW).cast("timestamp")
    day = lambda n: now + F.make_dt_interval(days=F.lit(n))
    s = c.join(o, c.c_custkey == o.o_custkey, "left").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, "active").otherwise("ended").alias("licence"), F.when(k % 11 == 0, day(-1)).otherwise(day(30)).alias("licence_ends"),
        F.col("n_orders").isNotNull().alias("credentials"), (F.col("n_orders") % 9).alias("refresh_failures"), F.when(k % 13 == 0, "running").when(k % 19 == 0, "gated").otherwise("ready").alias("state"),
        F.greatest(F.lit(0), F.coalesce("n_open", F.lit(0)) - 8).alias("active_jobs"), F.when(k % 17 == 0, day(1)).alias("cooldown_until"),
    )
    return s.select("c_custkey", C.first_gate(now).alias("gate"))


@query("select job_id, case when status = 'COMPLETED' then 'cooldown' when status = 'FAILED' and job_id % 3 = 0 then 'gated' else 'ready' end next_state, case when status = 'COMPLETED' then scheduled_at + interval 15 minute end cooldown_until from jobs where status in ('COMPLETED', 'FAILED', 'CANCELLED')")
def completion_transition(spark, d):
    """What a workspace becomes when a run ends: cooling down after success, gated after errors of authorisation or configuration, else ready."""
    j = V.sync_jobs(spark, d).where(F.col("status").isin("COMPLETED", "FAILED", "CANCELLED"))
    text = F.when(F.col("job_id") % 3 != 0, "connection reset").when(F.col("job_id") % 2 == 0, "401 unauthorized").otherwise("account not found")
    state = C.after_run(F.col("status"), labels.error_class(text))
    return j.select("job_id", state.alias("next_state"), F.when(state == "cooldown", F.col("scheduled_at") + F.expr("interval 15 minutes")).alias("cooldown_until"))


@query("select k, case when processor_payment_id in (select processor_payment_id from outc where match_type = 'auto') then 'matched' else event_type end state from proc")
def update_by_subquery(spark, d):
    """UPDATE .. WHERE id IN (subquery): a left join to the distinct keys, as rows elsewhere stay."""
    keys = V.outcomes(spark, d).where("match_type = 'auto'").select("processor_payment_id").distinct().withColumn("_hit", F.lit("matched"))
    return V.processor_facts(spark, d).join(keys, "processor_payment_id", "left").select("k", F.coalesce("_hit", "event_type").alias("state"))


@query("select o.k, coalesce(case when o.k % 3 = 0 then null else o.match_confidence end, r.score) confidence from outc o left join (select k, min(match_confidence) score from outc where k % 6 = 0 group by k) r on r.k = o.k")
def backfill_from_reviews(spark, d):
    """Confidences that are missing, filled from the first review of the same fact."""
    o = V.outcomes(spark, d)
    reviews = o.where("k % 6 = 0").select("k", F.explode(F.array("match_confidence", F.col("match_confidence") + 5)).alias("s")).groupBy("k").agg(F.min("s").alias("score"))
    return o.select("k", F.when(F.col("k") % 3 != 0, F.col("match_confidence")).alias("c")).join(reviews, "k", "left").select("k", F.coalesce("c", "score").alias("confidence"))


@query("select workspace_id, count(*) filter (match_type = 'auto') ready, count(*) filter (match_type = 'pending') needs_review, count(*) filter (match_type = 'unmatched') unmatched, count(*) filter (match_type = 'already_created') already_created from outc group by 1")
def section_counts(spark, d):
    """Sections of a run as columns, with zeros where there is none."""
    kinds = ["auto", "pending", "unmatched", "already_created"]
    n = V.outcomes(spark, d).groupBy("workspace_id").pivot("match_type", kinds).count().na.fill(0)
    return n.select("workspace_id", F.col("auto").alias("ready"), F.col("pending").alias("needs_review"), "unmatched", "already_created")


@query("select distinct sync_run_id, processor_object_id from raw where object_type = 'purchase'")
def run_objects(spark, d):
    return V.raw_objects(spark, d).where("object_type = 'purchase'").select("sync_run_id", "processor_object_id").distinct()


@query("select sync_run_id, count(*) filter (first and k is not null) inserted, count(*) filter (not first) skipped, count(*) filter (first and k is null) errors from (select sync_run_id, try_cast(json_extract_string(raw_json, '$.k') as int) k, row_number() over (partition by object_type, processor_object_id order by id) = 1 first from raw) group by 1")
def backfill_counters(spark, d):
    """What a backfill of raw events does, by run: keys seen first are inserted if their body can be read, the others skipped."""
    r = V.raw_objects(spark, d)
    first = r.groupBy("object_type", "processor_object_id").agg(F.min("id").alias("first_id"))
    j = r.join(first, ["object_type", "processor_object_id"]).withColumn("first", F.col("id") == F.col("first_id")).withColumn("k", F.get_json_object("raw_json", "$.k").try_cast("int"))
    return j.groupBy("sync_run_id").agg(F.count_if(F.col("first") & F.col("k").isNotNull()).alias("inserted"), F.count_if(~F.col("first")).alias("skipped"), F.count_if(F.col("first") & F.col("k").isNull()).alias("errors"))


@query("""select count(*) filter (first and k is not null) inserted, count(*) filter (not first) skipped, count(*) filter (first and k is null) errors, count(distinct sync_run_id) runs from (select sync_run_id, try_cast(json_extract_string(raw_json, '$.k') as int) k, row_number() over (partition by object_type, processor_object_id order by id) = 1 first from raw)""")
def backfill_observed(spark, d):
    """The totals of a backfill, observed as its rows are written: no second pass counts them."""
    r = V.raw_objects(spark, d)
    first = r.groupBy("object_type", "processor_object_id").agg(F.min("id").alias("first_id"))
    j = r.join(first, ["object_type", "processor_object_id"]).select("id", "sync_run_id", (F.col("id") == F.col("first_id")).alias("first"), F.get_json_object("raw_json", "$.k").try_cast("int").alias("k"))
    path = folder_of(spark, "backfill") + "/rows"
    seen = O.write_counted(j, path, {"inserted": F.count_if(F.col("first") & F.col("k").isNotNull()), "skipped": F.count_if(~F.col("first")), "errors": F.count_if(F.col("first") & F.col("k").isNull())})
    runs = spark.read.parquet(path).agg(F.count_distinct("sync_run_id").alias("runs"))
    return runs.select(*[F.lit(seen[n]).cast("long").alias(n) for n in ("inserted", "skipped", "errors")], "runs")


@query("select workspace_id, count(*) filter (event_type = 'payment_observed') payments, count(*) filter (event_type = 'refund_observed') refunds, count(*) filter (event_type = 'payment_observed' and k % 5 = 0) payments_created, count(*) filter (event_type = 'refund_observed' and k % 5 = 0) refunds_created from acct group by 1")
def accounting_sync_counters(spark, d):
    """Objects fetched and created by an accounting sync, by workspace and type."""
    a, old = V.accounting_facts(spark, d), V.accounting_facts(spark, d).where("k % 5 <> 0").select("accounting_id", F.lit(True).alias("old"))
    j = a.join(old, "accounting_id", "left")
    of = lambda kind, new: F.count_if((F.col("event_type") == kind) & (F.col("old").isNull() if new else F.lit(True)))
    return j.groupBy("workspace_id").agg(of("payment_observed", False).alias("payments"), of("refund_observed", False).alias("refunds"), of("payment_observed", True).alias("payments_created"), of("refund_observed", True).alias("refunds_created"))


@query("select workspace_id, max(proc_date) latest, count(*) n from proc group by 1")
def latest_snapshot(spark, d):
    return V.processor_facts(spark, d).groupBy("workspace_id").agg(F.max("proc_date").alias("latest"), F.count(F.lit(1)).alias("n"))


@query("select distinct proc_date from proc where payment_method = 'bank_account' order by proc_date desc limit 14")
def newest_transfer_dates(spark, d):
    return V.processor_facts(spark, d).where("payment_method = 'bank_account'").select("proc_date").distinct().orderBy(F.col("proc_date").desc()).limit(14)


@query("select c_custkey, o_orderkey from customer join orders on o_custkey = c_custkey qualify row_number() over (partition by c_custkey order by case when o_orderkey % 3 = 0 then null else o_orderdate end desc nulls last, o_orderkey) = 1", head=False)
def config_precedence(spark, d):
    """The setting that holds for each workspace: the newest, those without a date last."""
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer").select("c_custkey")
    at = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    order = F.struct(at.isNull().alias("none"), (-F.unix_micros(at.cast("timestamp"))).alias("at"), "o_orderkey")  # smallest first, one aggregate
    return o.groupBy("o_custkey").agg(F.min(order)["o_orderkey"].alias("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query("select k, posting_plan_id from batches where status = 'complete' order by settlement_date, k limit 25")
def oldest_payouts(spark, d):
    """Payouts by settlement date, oldest first."""
    return V.payout_batches(spark, d).where("status = 'complete'").orderBy("settlement_date", "k").limit(25).select("k", "posting_plan_id")


@query("select workspace_id from jobs where status in ('CLAIMED', 'RUNNING') order by scheduled_at, job_id limit 1")
def first_active_workspace(spark, d):
    return C.active(V.sync_jobs(spark, d)).orderBy("scheduled_at", "job_id").limit(1).select("workspace_id")


@query("select processor_payment_id, event_type, printf('%.2f', abs(amount_gross)) amount_key from proc where event_type in ('payment', 'refund', 'ach_return')")
def lookup_pool(spark, d):
    """Payments, refunds and returns in one pool, each with its key of amount."""
    p = V.processor_facts(spark, d).where(F.col("event_type").isin("payment", "refund", "ach_return"))
    return p.select("processor_payment_id", "event_type", labels.amount_key(F.col("amount_gross")).alias("amount_key"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null else date '2024-01-01' + cast(c_custkey % 200 as int) end cursor_at, case when c_custkey % 4 = 0 and c_custkey % 8 = 0 then date '2024-07-01' - 62 when c_custkey % 4 = 0 then date '2024-07-01' - 7 else date '2024-01-01' + cast(c_custkey % 200 as int) end starts, least(case when c_custkey % 4 = 0 and c_custkey % 8 = 0 then date '2024-07-01' - 62 when c_custkey % 4 = 0 then date '2024-07-01' - 7 else date '2024-01-01' + cast(c_custkey % 200 as int) end, date '2024-07-01' - 14) transfer_starts from customer", head=False)
def stream_starts(spark, d):
    """Where each source's next read begins: at its cursor, 62 days back the first time, 7 days back where a cursor was lost; bank transfers 14 days back at least."""
    c, today = V.table(spark, d, "customer"), F.lit("2024-07-01").cast("date")
    k = F.col("c_custkey")
    at = F.when(k % 4 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")))
    starts = labels.stream_start(at, k % 8 == 0, today)
    return c.select("c_custkey", at.alias("cursor_at"), starts.alias("starts"), labels.transfer_start(starts, today).alias("transfer_starts"))


_STATE = ", ws as (select distinct workspace_id, cast(substr(workspace_id, 4) as int) % 3 = 0 running from jobs), act as (select workspace_id, count(*) filter (status = 'RUNNING' and sync_run_id < 2) active, max(case when status = 'RUNNING' and sync_run_id < 2 then scheduled_at end) since from jobs group by 1)"


def _states(spark, d):
    """Workspaces, every third said to be running, with their active jobs of the two newest runs."""
    j = V.sync_jobs(spark, d)
    act = F.when((F.col("status") == "RUNNING") & (F.col("sync_run_id") < 2), F.col("scheduled_at"))
    return j.groupBy("workspace_id").agg(F.count(act).alias("active"), F.max(act).alias("since")).withColumn("running", F.substring("workspace_id", 4, 9).cast("int") % 3 == 0)


@query(_STATE + " select workspace_id, case when running then 'one_active_job' else 'no_active_job' end as invariant, active from ws join act using (workspace_id) where running and active <> 1 or not running and active <> 0")
def workspace_state_violations(spark, d):
    """A running workspace has exactly one active job, any other has none."""
    s = _states(spark, d).where((F.col("running") & (F.col("active") != 1)) | (~F.col("running") & (F.col("active") != 0)))
    return s.select("workspace_id", F.when(F.col("running"), "one_active_job").otherwise("no_active_job").alias("invariant"), "active")


@query(_STATE + f" select workspace_id from ws join act using (workspace_id) where running and (since is null or since < timestamp '{NOW}' - interval 20 minute)")
def tripwire(spark, d):
    """Workspaces said to be running for over 20 minutes, by real timestamps."""
    return _states(spark, d).where(F.col("running") & (F.col("since").isNull() | (F.col("since") < F.lit(NOW).cast("timestamp") - F.expr("interval 20 minutes")))).select("workspace_id")


@query("select p.k from proc p join outc o using (processor_payment_id) where p.workspace_id <> case when o.k % 33 = 0 then 'ws_x' else o.workspace_id end")
def ownership_violations(spark, d):
    """Outcomes that belong to another workspace than their fact (some are moved here)."""
    o = V.outcomes(spark, d).select("processor_payment_id", F.when(F.col("k") % 33 == 0, "ws_x").otherwise(F.col("workspace_id")).alias("owner"))
    return V.processor_facts(spark, d).join(o, "processor_payment_id").where("workspace_id <> owner").select("k")


@query("select c_custkey, (case when c_nationkey % 5 = 0 then 1 else 0 end) + (case when c_acctbal < 0 then 1 else 0 end) missing from customer where c_nationkey % 5 = 0 or c_acctbal < 0", head=False)
def incomplete_connections(spark, d):
    """Connected rows that lack what a connection needs: a realm, a token."""
    c = V.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey")).alias("realm"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("token"))
    missing = F.col("realm").isNull().cast("int") + F.col("token").isNull().cast("int")
    return c.select("c_custkey", missing.alias("missing")).where("missing > 0")


@query("select k, nullif(trim(case when k % 3 = 0 then '' else 'F' || k end || ' ' || case when k % 4 = 0 then '' else 'L' || k end), '') name from proc")
def full_names(spark, d):
    """First and last names in one, blank as null."""
    k = F.col("k")
    first, last = F.when(k % 3 != 0, F.concat(F.lit("F"), k.cast("string"))).otherwise(""), F.when(k % 4 != 0, F.concat(F.lit("L"), k.cast("string"))).otherwise("")
    return V.processor_facts(spark, d).select("k", labels.full_name(first, last).alias("name"))


_ORIG = """, r0 as (select k, case when event_type = 'payment' then processor_payment_id end processor_payment_id, processor_payout_id, case when event_type = 'refund' then processor_payment_id end processor_refund_id, amount_gross, amount_gross - k % 3 amount_net, cast(k % 3 as varchar) fees, event_type, customer_email, customer_name, 'cus' || k % 100 processor_customer_id, payment_method, case when k % 2 = 0 then 'visa' end card_brand, lpad(cast(k % 10000 as varchar), 4, '0') card_last4, 'about ' || k description from proc where event_type <> 'ach_return'),
key as (select *, coalesce(processor_payment_id, processor_refund_id) rk from r0)"""
_FIELDS = ["processor_payment_id", "processor_payout_id", "processor_refund_id", "amount_gross", "amount_net", "fees", "event_type", "customer_email", "customer_name", "processor_customer_id", "payment_method", "card_brand", "card_last4", "description"]


def _replayed(spark, d):
    """Facts with the fourteen fields that a replay compares, and a replay of them that is wrong here and there."""
    k = F.col("k")
    p = V.processor_facts(spark, d).where("event_type <> 'ach_return'")
    full = p.select("k", F.when(F.col("event_type") == "payment", F.col("processor_payment_id")).alias("processor_payment_id"), "processor_payout_id", F.when(F.col("event_type") == "refund", F.col("processor_payment_id")).alias("processor_refund_id"), "amount_gross", (F.col("amount_gross") - k % 3).alias("amount_net"), (k % 3).cast("string").alias("fees"), "event_type", "customer_email", "customer_name", F.concat(F.lit("cus"), (k % 100).cast("string")).alias("processor_customer_id"), "payment_method", F.when(k % 2 == 0, "visa").alias("card_brand"), F.lpad((k % 10000).cast("string"), 4, "0").alias("card_last4"), F.concat(F.lit("about "), k.cast("string")).alias("description"))
    new = full.where("k % 50 <> 7").withColumn("fees", F.concat(F.col("fees"), F.lit(".00"))).withColumn("card_brand", F.coalesce("card_brand", F.lit(" "))).withColumn("description", F.when(k % 29 == 0, "another").otherwise(F.col("description"))).withColumn("card_last4", F.when(k % 31 == 0, "x").otherwise(F.col("card_last4")))
    return R.keyed(full.where("k % 60 <> 9")), R.keyed(new)


@query(_ORIG + """ select count(*) filter (k % 60 <> 9 and k % 50 = 7) missing, count(*) filter (k % 60 = 9 and k % 50 <> 7) extra, count(*) filter (k % 60 <> 9 and k % 50 <> 7 and (k % 29 = 0 or k % 31 = 0)) differing, count(*) filter (k % 60 <> 9 and k % 50 <> 7 and k % 29 <> 0 and k % 31 <> 0) equal, false passed from key""")
def replay_verdict(spark, d):
    """The verdict over all fourteen fields and every kind of key: passed if nothing is missing, extra or different."""
    return R.verdict(*_replayed(spark, d), _FIELDS)


@query(_ORIG + """ select rk, 'description' field from key where k % 60 <> 9 and k % 50 <> 7 and k % 29 = 0 union all select rk, 'card_last4' from key where k % 60 <> 9 and k % 50 <> 7 and k % 31 = 0""")
def replay_differences(spark, d):
    """Which of the fourteen fields differ, by key; numbers are compared to two places, blanks count as nothing."""
    original, replay = _replayed(spark, d)
    return R.field_differences(original.withColumnRenamed("rk", "key_"), replay.withColumnRenamed("rk", "key_"), _FIELDS, key="key_").select(F.col("key_").alias("rk"), "field")
