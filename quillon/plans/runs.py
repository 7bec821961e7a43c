"""Runs kept with their results, single events, claims, duplicates, retries, reports, activation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators import commits, replay
from quillon.operators import control as C
from quillon.operators import deposits as D
from quillon.operators import matching as M
from quillon.operators.ranges import ids_hashes
from quillon.plans.audits import _REPLAY
from quillon.plans.audits import _sides as _replayed
from quillon.plans.catalogue import query
from quillon.plans.matches import _EXACT, _LEFT, _run
from quillon.sources import views as V
from quillon.sources.scratch import folder_of
from quillon.streaming import ingest as I

_HITS = _EXACT.replace("select * from acct where", "select *, case event_type when 'refund_observed' then 'refund' else 'payment' end kind from acct where").replace("workspace_id, ref_no", "workspace_id, ref_no, event_type")


@query(_LEFT + _HITS + """, gone as (select distinct txn_id from dep_lines where not typed or txn_type = 'Payment'),
hit as (select p.workspace_id, ix.accounting_id from proc p join ix on p.workspace_id = ix.workspace_id and p.processor_payment_id = ix.ref_no and p.event_type = ix.kind
  where p.processor_payment_id not in (select processor_payment_id from explained) and ix.accounting_id not in (select txn_id from gone)),
run as (select workspace_id, sha256('["' || string_agg(processor_payment_id, '", "' order by processor_payment_id) || '"]') run_id, count(*) n_facts from proc group by 1)
select run_id, workspace_id, n_facts, count(accounting_id) n_results from run left join hit using (workspace_id) group by all""")
def match_run_persisted(spark, d):
    """A run row for each workspace, its id the hash of its input, and the exact results under that id; the two tables are committed together, and again without effect."""
    p = V.processor_facts(spark, d)
    runs = ids_hashes(p, "workspace_id", F.col("processor_payment_id")).select(F.col("hash").alias("run_id"), F.col("key").alias("workspace_id"), F.col("n").alias("n_facts"))
    folder = folder_of(spark, "runs")
    found = _run(spark, d, M.exact_matches).join(p.select("processor_payment_id", "workspace_id"), "processor_payment_id").join(runs.select("run_id", "workspace_id"), "workspace_id")
    tables = {"runs": runs, "results": found.select("run_id", "processor_payment_id", "accounting_id", "pass")}
    for _ in range(2):
        commits.commit(spark, folder, "first", tables)
    kept_runs, results = (commits.visible(spark, folder, n, df.schema) for n, df in tables.items())
    return kept_runs.join(results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")), "run_id", "left").select("run_id", "workspace_id", "n_facts", F.coalesce("n", F.lit(0)).alias("n_results"))


@query("select event_id, event_type from events where ts < timestamp '2024-01-20' or event_id % 1000 = 999", head=False)
def stream_single_events(spark, d):
    """A backfill up to a day, and after it single events by their id, each merged by itself's own small batch; the second time they change nothing."""
    folder = folder_of(spark, "single")
    e = V.table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    merge = I.merge_into(f"{folder}/table", ["event_id"], "ts")
    merge(e.where("ts < timestamp '2024-01-20'"), 0)
    for _ in range(2):
        merge(e.where("event_id % 1000 = 999"), 1)
    return spark.read.parquet(f"{folder}/table").select("event_id", "event_type")


@query("""select b.k, b.posting_plan_id, tries, net_amount from batches b join (select 'plan' || l_orderkey posting_plan_id, count(*) tries from lineitem group by 1) t using (posting_plan_id) where status <> 'posted' and tries < 5""")
def plan_retries(spark, d):
    """Plans that aren't posted and may be tried again, with their batches: tries are counted from the log of attempts."""
    attempts = V.table(spark, d, "lineitem").groupBy(F.concat(F.lit("plan"), F.col("l_orderkey").cast("string")).alias("posting_plan_id")).agg(F.count(F.lit(1)).alias("tries"))
    return V.payout_batches(spark, d).where("status <> 'posted'").join(attempts.where("tries < 5"), "posting_plan_id").select("k", "posting_plan_id", "tries", "net_amount")


@query("""select job_id, workspace_id, sha256('worker-7|' || job_id) token, timestamp '2024-01-20 12:05:00' until from (select *, count(*) filter (status = 'RUNNING') over (partition by workspace_id) running from jobs)
where status = 'QUEUED' and scheduled_at <= timestamp '2024-01-20 12:00:00' and running < 70 order by priority, scheduled_at, job_id limit 1""")
def job_claim_token(spark, d):
    """The claim of the next job: its token, by which only the claiming worker may go on, and until when it holds without a heartbeat."""
    job = C.claim(V.sync_jobs(spark, d), "2024-01-20 12:00:00", limit=70)
    token = F.sha2(F.concat(F.lit("worker-7|"), F.col("job_id").cast("string")), 256)
    return job.select("job_id", "workspace_id", token.alias("token"), (F.lit("2024-01-20 12:00:00").cast("timestamp") + F.expr("interval 5 minutes")).alias("until"))


@query(""", old as (select workspace_id, 'd' || k deposit_id, settlement_date on_day, net_amount + case k % 3 when 0 then 0 when 1 then 0.005 else 0.5 end total, 'made at noon' || chr(10) || 'Payout: ' || processor_payout_id memo from batches where k % 2 = 0)
select b.k, old.deposit_id from batches b join old on old.workspace_id = b.workspace_id and on_day = settlement_date and contains(memo, processor_payout_id) and abs(total - net_amount) < 0.01""")
def existing_deposits(spark, d):
    """For each payout the deposit that there is already: of its day, with its id in the memo, and its amount to less than a cent."""
    b, k = V.payout_batches(spark, d), F.col("k")
    memo = F.concat(F.lit("made at noon\nPayout: "), "processor_payout_id")
    old = b.where("k % 2 = 0").select("workspace_id", F.concat(F.lit("d"), k.cast("string")).alias("deposit_id"), F.col("settlement_date").alias("day"), (F.col("net_amount") + F.when(k % 3 == 0, 0).when(k % 3 == 1, 0.005).otherwise(0.5).cast("decimal(18,3)")).alias("total"), memo.alias("memo"))
    return D.existing(b, old).select("k", "deposit_id")


_ZONES = """z as (select o_orderkey, o_orderdate at_utc, case o_orderkey % 4 when 0 then 'America/New_York' when 1 then 'America/Vancouver' when 2 then 'Australia/Sydney' else 'Europe/London' end zone from orders),
l as (select *, (at_utc at time zone 'UTC') at time zone zone local_at from (select o_orderkey, zone, cast(at_utc as timestamp) at_utc from z))"""


@query(f"with {_ZONES} select o_orderkey, zone, local_at, case zone when 'America/New_York' then case when date_diff('minute', at_utc, local_at) = -240 then 'EDT' else 'EST' end when 'America/Vancouver' then case when date_diff('minute', at_utc, local_at) = -420 then 'PDT' else 'PST' end when 'Australia/Sydney' then case when date_diff('minute', at_utc, local_at) = 660 then 'AEDT' else 'AEST' end else case when date_diff('minute', at_utc, local_at) = 60 then 'BST' else 'GMT' end end abbreviation from l", head=False)
def local_stamps(spark, d):
    """Times in a workspace's own zone, with the zone's abbreviation at that time."""
    k, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    zone = F.when(k % 4 == 0, "America/New_York").when(k % 4 == 1, "America/Vancouver").when(k % 4 == 2, "Australia/Sydney").otherwise("Europe/London")
    rows = V.table(spark, d, "orders").select("o_orderkey", zone.alias("zone"), at.alias("at"), F.from_utc_timestamp(at, zone).alias("local_at"))
    return rows.select("o_orderkey", "zone", "local_at", labels.zone_abbreviation(F.col("zone"), F.col("at"), F.col("local_at")).alias("abbreviation"))


@query(_REPLAY + """, m as (select o.workspace_id ow, r.workspace_id rw, o.k ok, r.k rk, o.amount_gross is distinct from r.amount_gross or o.customer_name is distinct from r.customer_name differs from orig o full join rep r using (processor_payment_id))
select coalesce(ow, rw) workspace_id, count(ok) originals, count(rk) replayed, count(*) filter (rk is null) missing, count(*) filter (ok is null) extra, count(*) filter (ok is not null and rk is not null and differs) differing, case when count(*) filter (ok is null or rk is null or differs) = 0 then 'equivalent' when count(rk) = 0 then 'failed' else 'differences' end verdict from m group by 1""")
def replay_report(spark, d):
    """The report of a replay by workspace: what was there, what the replay made, what is missing, extra or different, and the verdict."""
    return replay.report(*_replayed(spark, d), ["amount_gross", "customer_name", "customer_email", "payment_method"])


_GRANT = """w as (select c_custkey id from customer where c_custkey % 17 <> 0), l as (select o_custkey workspace, case o_orderkey % 4 when 0 then 'trial' when 1 then 'active' when 2 then 'cancelled' else 'active' end status, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) + 2600 end ends_at, case when o_orderkey % 4 = 0 then cast(o_orderdate as date) + 2500 end trial_ends_at, o_orderkey % 13 = 0 deleted, o_orderkey % 25 app from orders),
a as (select n_nationkey app, n_regionkey in (1, 2) needs from nation), g as (select w.id, count(*) filter (not deleted and status in ('trial', 'active') and (ends_at is null or ends_at > date '2004-01-20') and (trial_ends_at is null or trial_ends_at > date '2004-01-20') and needs) n from w left join l on l.workspace = w.id left join a using (app) group by 1)"""


def _granted(spark, d):
    """Workspaces that aren't deleted, with the number of their licences that hold for an app which needs the connection."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    now = F.lit("2004-01-20").cast("date")
    w = V.table(spark, d, "customer").where("c_custkey % 17 <> 0").select(F.col("c_custkey").alias("id"), "c_nationkey")
    l = V.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.when(k % 4 == 0, "trial").when(k % 4 == 2, "cancelled").otherwise("active").alias("status"), F.when(k % 5 != 0, F.date_add(day, 2600)).alias("ends_at"), F.when(k % 4 == 0, F.date_add(day, 2500)).alias("trial_ends_at"), (k % 13 == 0).alias("deleted"), (k % 25).alias("app"))
    a = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("app"), F.col("n_regionkey").isin(1, 2).alias("needs"))
    later = lambda c: F.col(c).isNull() | (F.col(c) > now)
    good = ~F.col("deleted") & F.col("status").isin("trial", "active") & later("ends_at") & later("trial_ends_at") & F.col("needs")
    return w.join(l.join(a, "app", "left"), "id", "left").groupBy("id", "c_nationkey").agg(F.count_if(good).alias("n"))


@query(f"with {_GRANT} select id, n > 0 allowed from g", head=False)
def connect_allowed_by_licence(spark, d):
    """Whether a workspace may connect: by trials and licences that hold, for apps that need the connection."""
    return _granted(spark, d).select("id", (F.col("n") > 0).alias("allowed"))


@query(f"with {_GRANT} select id, n > 0 entitlement_valid, case c_nationkey % 4 when 0 then null when 1 then 'CONNECTED' when 2 then 'EXPIRED' else 'CONNECTED' end connection, n > 0 and c_nationkey % 4 in (1, 3) activation_ready, id % 3 = 0 activation_completed from g join customer on c_custkey = id", head=False)
def activation_full(spark, d):
    """A workspace's activation: entitlement, connection, whether it is ready (both hold), and whether it was claimed before."""
    n = F.col("c_nationkey") % 4
    state = F.when(n == 2, "EXPIRED").when(n != 0, "CONNECTED")
    valid = F.col("n") > 0
    return _granted(spark, d).select("id", valid.alias("entitlement_valid"), state.alias("connection"), (valid & F.coalesce(state == "CONNECTED", F.lit(False))).alias("activation_ready"), (F.col("id") % 3 == 0).alias("activation_completed"))
