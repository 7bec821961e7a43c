"""Audits, gates, job control, lineage and replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators import control as C
from quillon.operators import replay as R
from quillon.plans.catalogue import query
from quillon.sources import views as V

NOW = "2024-01-20 12:00:00"


@query("select workspace_id, match_type, count(*) n, max(match_confidence) most from outc group by all")
def sync_status(spark, d):
    return V.outcomes(spark, d).groupBy("workspace_id", "match_type").agg(F.count(F.lit(1)).alias("n"), F.max("match_confidence").alias("most"))


@query("select status, count(*) n from jobs group by 1")
def jobs_by_status(spark, d):
    return V.sync_jobs(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select workspace_id, count(*) n from jobs where status = 'RUNNING' group by 1 having count(*) > 1")
def running_per_workspace(spark, d):
    """Workspaces with more than one running job."""
    return V.sync_jobs(spark, d).where("status = 'RUNNING'").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("select workspace_id, coalesce(max(priority) filter (status = 'QUEUED'), -1) + 1 priority from jobs group by 1")
def next_priority(spark, d):
    return V.sync_jobs(spark, d).groupBy("workspace_id").agg((F.coalesce(F.max(F.when(F.col("status") == "QUEUED", F.col("priority"))), F.lit(-1)) + 1).alias("priority"))


@query(f"""select job_id, workspace_id from (select *, count(*) filter (status = 'RUNNING') over (partition by workspace_id) running from jobs)
where status = 'QUEUED' and scheduled_at <= timestamp '{NOW}' and running < 70 order by priority, scheduled_at, job_id limit 1""")
def job_claim(spark, d):
    """The job to run next: queued, due, in a workspace below its limit; by priority, then age."""
    return C.claim(V.sync_jobs(spark, d), NOW, limit=70).select("job_id", "workspace_id")


@query(f"select job_id, case when retry_count < max_retries then 'requeue' else 'fail' end as action from jobs where status in ('CLAIMED', 'RUNNING') and heartbeat_at < timestamp '{NOW}' - interval 5 minute")
def stale_jobs(spark, d):
    return C.stale(V.sync_jobs(spark, d), NOW)


@query("select distinct workspace_id, sync_run_id from jobs j where status = 'COMPLETED' and not exists (select 1 from jobs r where r.workspace_id = j.workspace_id and r.sync_run_id = j.sync_run_id and r.status in ('CLAIMED', 'RUNNING'))")
def orphan_runs(spark, d):
    """Runs of a workspace without an active job."""
    jobs, keys = V.sync_jobs(spark, d), ["workspace_id", "sync_run_id"]
    return jobs.where("status = 'COMPLETED'").select(*keys).distinct().join(C.active(jobs).select(*keys), keys, "left_anti")


@query("""with l as (select workspace_id, sync_run_id, count(*) n from jobs where status = 'CANCELLED' group by 1, 2) select l.workspace_id, l.sync_run_id, l.n from l
where not exists (select 1 from jobs j where j.workspace_id = l.workspace_id and j.sync_run_id = l.sync_run_id and status = 'RUNNING') and not exists (select 1 from jobs j where j.workspace_id = l.workspace_id and j.sync_run_id = l.sync_run_id + 1 and status = 'CLAIMED')""".replace("with l as", ", l as"))
def orphan_locks(spark, d):
    """Locks of a run that has neither a running job nor a claimed one that follows: two anti-joins."""
    jobs, keys = V.sync_jobs(spark, d), ["workspace_id", "sync_run_id"]
    locks = jobs.where("status = 'CANCELLED'").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    follows = jobs.where("status = 'CLAIMED'").select("workspace_id", (F.col("sync_run_id") - 1).alias("sync_run_id"))
    return locks.join(jobs.where("status = 'RUNNING'").select(*keys), keys, "left_anti").join(follows, keys, "left_anti")


@query("""select 'single_running' as invariant, workspace_id subject from jobs where status = 'RUNNING' group by workspace_id having count(*) > 1
union all select 'retries', cast(job_id as varchar) from jobs where retry_count >= max_retries and status = 'QUEUED'
union all select 'auto_threshold', processor_payment_id from outc where match_type = 'auto' and match_confidence < 85""")
def invariant_violations(spark, d):
    return C.violations(V.sync_jobs(spark, d), V.outcomes(spark, d))


@query(f"""select workspace_id, case when success = 0 then 'no_credentials' when failures % 9 >= 5 then 'refresh_failures' when running % 4 = 0 then 'running' when running % 5 = 0 then 'active_jobs' when last_at > timestamp '{NOW}' then 'cooldown' else 'open' end gate,
case when total = 0 then 1.0 else round(greatest(0, success / total - case when last_ok < timestamp '{NOW}' - interval 24 hour then 0.2 else 0 end - least(0.3, 0.1 * (failures % 4))), 2) end health,
case when failures > 0 and success > 0 then 'partially_completed' when failures > 0 then 'failed' when running > 0 then 'completed_with_ambiguity' else 'completed' end terminal
from (select workspace_id, count(*) total, count(*) filter (status = 'COMPLETED') success, count(*) filter (status = 'FAILED') failures, count(*) filter (status = 'RUNNING') running, max(heartbeat_at) last_at, max(heartbeat_at) filter (status = 'COMPLETED') last_ok from jobs group by 1)""")
def sync_gates(spark, d):
    """The first gate that stops a workspace, its health, and how its last run would end."""
    return C.gates(V.sync_jobs(spark, d), NOW)


@query("""select job_id, previous, status from (select job_id, status, lag(status) over (partition by workspace_id order by scheduled_at, job_id) previous from jobs)
where previous is not null and (previous, status) not in (('QUEUED','CLAIMED'), ('CLAIMED','RUNNING'), ('RUNNING','COMPLETED'), ('RUNNING','FAILED'), ('FAILED','RETRYING'), ('RETRYING','QUEUED'), ('QUEUED','CANCELLED'))""")
def transition_violations(spark, d):
    return C.transitions(V.sync_jobs(spark, d))


@query("select c_custkey, c_acctbal > 0 and c_nationkey % 3 <> 0 and o.n > 0 allowed from customer left join (select o_custkey, count(*) filter (o_orderstatus = 'F') n from orders group by 1) o on o_custkey = c_custkey", head=False)
def connect_allowed(spark, d):
    """A licence in force and a connection that works: left join and conditional count."""
    c, o = V.table(spark, d, "customer"), V.table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", ((F.col("c_acctbal") > 0) & (F.col("c_nationkey") % 3 != 0) & (F.col("n") > 0)).alias("allowed"))


@query("select o_orderkey, o_orderstatus = 'F' and coalesce(o_orderdate <= timestamp '1999-01-01', true) and coalesce(case when o_orderkey % 3 = 0 then null else o_orderdate + interval 365 day end > timestamp '1999-01-01', true) valid from orders", head=False)
def licence_valid(spark, d):
    o = V.table(spark, d, "orders")
    ends = F.when(F.col("o_orderkey") % 3 == 0, None).otherwise(F.col("o_orderdate").cast("timestamp") + F.expr("interval 365 day"))
    state = F.when(F.col("o_orderstatus") == "F", "active").otherwise("ended")
    return o.select("o_orderkey", labels.licence_valid(state, F.col("o_orderdate").cast("timestamp"), ends, F.lit("1999-01-01").cast("timestamp")).alias("valid"))


@query("select c_nationkey realm, count(distinct c_mktsegment) owners from customer group by 1 having count(distinct c_mktsegment) > 1", head=False)
def realm_conflicts(spark, d):
    """Realms that more than one workspace holds."""
    return V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("realm")).agg(F.count_distinct("c_mktsegment").alias("owners")).where("owners > 1")


@query("select object_type, count(*) n, list_sort(list(distinct processor_object_id))[1:5] sample from raw group by 1")
def raw_inventory(spark, d):
    """Objects of each type and the first five ids. Ranks stop at five in each task, so no group is gathered."""
    r = V.raw_objects(spark, d)
    first = F.row_number().over(Window.partitionBy("object_type").orderBy("processor_object_id"))
    sample = r.select("object_type", "processor_object_id").distinct().withColumn("_i", first).where("_i <= 5").groupBy("object_type").agg(F.array_sort(F.collect_list("processor_object_id")).alias("sample"))
    return r.groupBy("object_type").agg(F.count(F.lit(1)).alias("n")).join(sample, "object_type").select("object_type", "n", "sample")


@query("select workspace_id, object_type, processor_object_id, max(id) id, arg_max(raw_json, id) raw_json from raw group by 1, 2, 3")
def raw_latest(spark, d):
    return R.snapshot(V.raw_objects(spark, d))


@query("select id, previous from (select id, raw_json, lag(raw_json) over (partition by object_type, processor_object_id order by captured_at, id) previous from raw) where previous is not null and previous <> raw_json")
def raw_versions_changed(spark, d):
    w = Window.partitionBy("object_type", "processor_object_id").orderBy("captured_at", "id")
    return V.raw_objects(spark, d).withColumn("previous", F.lag("raw_json").over(w)).where("previous is not null and previous <> raw_json").select("id", "previous")


@query("""select p.processor_payment_id, b.k batch, o.accounting_id, a.acct_date from proc p left join batches b using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) left join acct a on a.accounting_id = o.accounting_id""")
def lineage_back(spark, d):
    """From facts back to batch, outcome and accounting object."""
    return R.back(V.processor_facts(spark, d), V.payout_batches(spark, d), V.outcomes(spark, d), V.accounting_facts(spark, d))


@query("select b.k batch, p.processor_payment_id, o.match_type from batches b join proc p using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) where b.status = 'posted'")
def lineage_forward(spark, d):
    b = V.payout_batches(spark, d).where("status = 'posted'").select(F.col("k").alias("batch"), "workspace_id", "processor", "processor_payout_id")
    o = V.outcomes(spark, d).select("workspace_id", "processor_payment_id", "match_type")
    return b.join(V.processor_facts(spark, d), ["workspace_id", "processor", "processor_payout_id"]).join(o, ["workspace_id", "processor_payment_id"], "left").select("batch", "processor_payment_id", "match_type")


@query("select run, missing from (select distinct sync_run_id run from raw) r cross join (select unnest(['purchase', 'refund', 'payout']) missing) t where not exists (select 1 from raw where sync_run_id = run and object_type = missing)")
def replay_missing_types(spark, d):
    """Object types that a run should hold and doesn't: runs with a list of three, less what is there."""
    raw = V.raw_objects(spark, d).select(F.col("sync_run_id").alias("run"), F.col("object_type").alias("missing")).distinct()
    wanted = raw.select("run").distinct().withColumn("missing", F.explode(F.array(*map(F.lit, ("purchase", "refund", "payout")))))
    return wanted.join(raw, ["run", "missing"], "left_anti")


_REPLAY = ", orig as (select * from proc where k % 10 <> 1), rep as (select * replace (case when k % 8 = 3 then amount_gross + 1 else amount_gross end as amount_gross, case when k % 6 = 2 then 'Other' else customer_name end as customer_name) from proc where k % 10 <> 2)"


def _sides(spark, d):
    p = V.processor_facts(spark, d)
    changed = p.where("k % 10 <> 2").withColumn("amount_gross", F.when(F.col("k") % 8 == 3, F.col("amount_gross") + 1).otherwise(F.col("amount_gross")).cast("decimal(18,2)")).withColumn("customer_name", F.when(F.col("k") % 6 == 2, "Other").otherwise(F.col("customer_name")))
    return p.where("k % 10 <> 1"), changed


@query(_REPLAY + " select processor_payment_id, 'missing' side from (select processor_payment_id from orig except select processor_payment_id from rep) union all select processor_payment_id, 'extra' from (select processor_payment_id from rep except select processor_payment_id from orig)")
def replay_key_diff(spark, d):
    return R.key_difference(*_sides(spark, d))


@query(_REPLAY + """ select case when o.k is null then 'extra' when r.k is null then 'missing' when o.amount_gross is distinct from r.amount_gross or o.customer_name is distinct from r.customer_name then 'differing' else 'equal' end result, count(*) n
from orig o full join rep r using (processor_payment_id) group by 1""")
def replay_equivalence(spark, d):
    return R.equivalence(*_sides(spark, d), ["amount_gross", "customer_name", "customer_email", "payment_method"])


@query(_REPLAY + """ select processor_payment_id, 'amount_gross' field, cast(o.amount_gross as varchar) was, cast(r.amount_gross as varchar) now from orig o join rep r using (processor_payment_id) where o.amount_gross <> r.amount_gross
union all select processor_payment_id, 'customer_name', o.customer_name, r.customer_name from orig o join rep r using (processor_payment_id) where o.customer_name <> r.customer_name""")
def replay_field_diffs(spark, d):
    return R.field_differences(*_sides(spark, d), ["amount_gross", "customer_name", "customer_email", "payment_method"])
