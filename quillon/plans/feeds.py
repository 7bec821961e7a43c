"""Feeds of the processors and the settings around them: pages, objects of each kind, batch lists, replayed objects, contexts, recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.operators import checks as K
from quillon.operators import control as C
from quillon.operators import posting as P
from quillon.plans.catalogue import query
from quillon.sources import bodies as B
from quillon.sources import paged
from quillon.sources import views as V
from quillon.sources.scratch import folder_of

NOW = "2024-01-20 12:00:00"


@query("select k, amount_gross amount, case when k // 100 % 3 <> 0 then 'tx' || max(k) over (partition by k // 100) end next_after from proc where processor = 'stripe' and event_type = 'payment'")
def charge_pages(spark, d):
    """Pages of charges, a file line each, read with a fixed schema; a page that isn't the last names the id to go on after."""
    path = folder_of(spark, "pages")
    B.charge_pages(V.processor_facts(spark, d).where("processor = 'stripe' and event_type = 'payment'")).write.text(path)
    return B.page_rows(spark.read.schema(B.PAGE).json(path))


def _recorded(spark, d):
    """Answers of the charge and refund listings of each workspace, recorded by month."""
    path = folder_of(spark, "recorded")
    p = V.processor_facts(spark, d).where("event_type in ('payment', 'refund')")
    body = F.to_json(F.struct((F.col("amount_gross") * 100).cast("long").alias("amount"), "customer_email"))
    month = (F.year("proc_date") - 1990) * 12 + F.month("proc_date")
    rows = p.select(F.when(F.col("event_type") == "refund", "refund").otherwise("charge").alias("object"), F.col("workspace_id").alias("source"), F.col("processor_payment_id").alias("id"), F.col("proc_date").alias("updated"), body.alias("body"), month.alias("n"))
    paged.write_pages(rows, path, "n")
    paged.register(spark)
    return spark.read.format("recorded_pages").load(path)


@query("select case when event_type = 'refund' then 'refund' else 'charge' end as object, workspace_id source, processor_payment_id id, proc_date updated, amount_gross amount, customer_email email from proc where event_type in ('payment', 'refund')")
def paged_listings(spark, d):
    """Charges and refunds of every workspace, read page after page by the cursor to the last one."""
    b = F.from_json("body", "amount long, customer_email string")
    return _recorded(spark, d).withColumn("b", b).select("object", "source", "id", "updated", (F.col("b.amount").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), F.col("b.customer_email").alias("email"))


@query("select workspace_id source, processor_payment_id id, proc_date updated from proc where event_type = 'refund' and proc_date >= date '1996-03-15'")
def paged_updated_since(spark, d):
    """Refunds updated since a day: the source takes the filters over, skips pages before the day and chains of charges."""
    return _recorded(spark, d).where("object = 'refund' and updated >= date '1996-03-15'").select("source", "id", "updated")


@query("select processor_payout_id id, net_amount amount, 'USD' currency, settlement_date arrives, case when k % 6 = 0 then 'pending' else 'paid' end status from batches where processor = 'stripe'")
def payout_rows(spark, d):
    """Payout bodies as rows: cents, epoch seconds, a state that may be missing."""
    return B.payout_rows(B.payout_bodies(V.payout_batches(spark, d).where("processor = 'stripe'")))


@query("select 'acct' || s_suppkey id, s_name as name, case when s_nationkey % 2 = 0 then 'USD' else 'CAD' end currency from supplier", head=False)
def account_rows(spark, d):
    """Account bodies as rows, with their nested profile."""
    s = V.table(spark, d, "supplier")
    currency = F.when(F.col("s_nationkey") % 2 == 0, "usd").otherwise("cad")
    body = F.to_json(F.struct(F.concat(F.lit("acct"), F.col("s_suppkey").cast("string")).alias("id"), currency.alias("default_currency"), F.struct(F.col("s_name").alias("name")).alias("business_profile")))
    a = s.select(F.from_json(body, B.ACCOUNT).alias("a"))
    return a.select("a.id", F.col("a.business_profile.name").alias("name"), F.upper("a.default_currency").alias("currency"))


@query("""select 'bt' || o_orderkey id, case when o_orderkey % 37 <> 0 then 'tx' || o_orderkey end charge, case when o_orderkey % 37 <> 0 and o_orderkey % 7 <> 0 then c_name end customer_name
from orders left join customer on o_custkey = c_custkey and c_custkey % 10 <> 3""", head=False)
def balance_chain(spark, d):
    """Balance transactions to their charge and its customer: lookups one by one become two left joins. Some have no source, some charges no customer, some customers aren't found."""
    o, c = V.table(spark, d, "orders"), V.table(spark, d, "customer").where("c_custkey % 10 <> 3")
    k = F.col("o_orderkey")
    name = lambda prefix, of: F.concat(F.lit(prefix), of.cast("string"))
    entries = o.select(F.from_json(F.to_json(F.struct(name("bt", k).alias("id"), F.when(k % 37 != 0, name("tx", k)).alias("source"))), "id string, source string").alias("b")).select("b.*")
    charges = o.select(F.from_json(F.to_json(F.struct(name("tx", k).alias("charge"), F.when(k % 7 != 0, name("cus", F.col("o_custkey"))).alias("customer"))), "charge string, customer string").alias("b")).select("b.*")
    customers = c.select(F.from_json(F.to_json(F.struct(name("cus", F.col("c_custkey")).alias("customer"), F.col("c_name").alias("customer_name"))), "customer string, customer_name string").alias("b")).select("b.*")
    return entries.join(charges, entries.source == charges.charge, "left").join(customers, "customer", "left").select("id", "charge", "customer_name")


@query("select processor_payout_id, settlement_date, 'Batch ' || processor_payout_id description from batches where processor = 'authorize_net' and k % 9 <> 0 and k % 11 <> 0")
def gateway_batch_list(spark, d):
    """Batch lists in XML, an answer for each workspace and 31 days: batches of settled states with a settlement time become payouts."""
    return B.batch_rows(B.batch_bodies(V.payout_batches(spark, d).where("processor = 'authorize_net'")))


@query("""select 'ach_transfer_' || proc_date payout_id, sum(case when not fee and event_type = 'payment' then amount_gross else 0 end) payments, sum(case when not fee and event_type = 'refund' then amount_gross else 0 end) refunds,
sum(case when fee then amount_gross else 0 end) fees, count(distinct processor_payout_id) n_batches from (select *, k % 15 = 0 fee from proc where payment_method = 'bank_account') group by proc_date""")
def ach_transfer_payouts(spark, d):
    """Bank transfers by day as payouts: payments, refunds and, by their description, fees, with the batches that they came in."""
    p = V.processor_facts(spark, d).where("payment_method = 'bank_account'").withColumn("description", F.when(F.col("k") % 15 == 0, "eCheck Service Charge").otherwise("transfer"))
    fee = labels.is_fee(F.col("description"))
    of = lambda cond: F.sum(F.when(cond, F.col("amount_gross")).otherwise(0))
    days = p.groupBy("proc_date").agg(of(~fee & (F.col("event_type") == "payment")).alias("payments"), of(~fee & (F.col("event_type") == "refund")).alias("refunds"), of(fee).alias("fees"), F.count_distinct("processor_payout_id").alias("n_batches"))
    return days.select(F.concat(F.lit("ach_transfer_"), F.col("proc_date").cast("string")).alias("payout_id"), "payments", "refunds", "fees", "n_batches")


@query(", w as (select distinct processor_object_id from raw where object_type = 'click'), f as (select processor_object_id, max(id) id from raw where object_type = 'purchase' and sync_run_id = '2024-01-05' group by 1) select processor_object_id, id, case when id is null then 'not stored: purchase ' || processor_object_id end error from w left join f using (processor_object_id)")
def replay_fetch(spark, d):
    """Objects that a replay asks for, from what a run has stored; one that is missing is an error row, never a call."""
    r = V.raw_objects(spark, d)
    wanted = r.where("object_type = 'click'").select("processor_object_id").distinct()
    stored = r.where("object_type = 'purchase' and sync_run_id = '2024-01-05'").groupBy("processor_object_id").agg(F.max("id").alias("id"))
    return wanted.join(stored, "processor_object_id", "left").select("processor_object_id", "id", F.when(F.col("id").isNull(), F.concat(F.lit("not stored: purchase "), "processor_object_id")).alias("error"))


@query(f"select k, case k % 3 when 0 then cast(proc_date as timestamp) + interval 90 second when 1 then cast(proc_date as timestamp) + interval 1 hour else timestamp '{NOW}' end processor_timestamp from proc where event_type in ('payment', 'refund')")
def charge_times(spark, d):
    """When a charge or refund was: its own time (epoch seconds of a charge, ISO text of a refund), else when it was received, else now."""
    p = V.processor_facts(spark, d).where(F.col("event_type").isin("payment", "refund"))
    k, day = F.col("k"), F.col("proc_date").cast("timestamp")
    own = day + F.expr("interval 90 seconds")
    iso = lambda at: F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX")
    created = F.to_json(F.struct(F.struct(F.struct(F.unix_timestamp(own).alias("created")).alias("charge_data")).alias("metadata")))
    body = F.when(k % 3 != 0, "{}").when(F.col("event_type") == "payment", created).otherwise(F.to_json(F.struct(iso(own).alias("refund_date"))))
    b = p.select("k", F.from_json(body, "metadata struct<charge_data:struct<created:long>>, refund_date string").alias("b"), F.when(k % 3 == 1, iso(day + F.expr("interval 1 hour"))).alias("received_at"))
    at = F.coalesce(F.timestamp_seconds("b.metadata.charge_data.created"), F.col("b.refund_date").try_cast("timestamp"), F.col("received_at").try_cast("timestamp"), F.lit(NOW).cast("timestamp"))
    return b.select("k", at.alias("processor_timestamp"))


@query("select k, settlement_date from (select *, case when k % 5 = 0 then 'ach_transfer_' || k else processor_payout_id end pid from batches where processor = 'authorize_net') where k % 7 <> 0 and settlement_date between date '1996-06-16' and date '1996-06-30' and (payout_type = 'ach' and k % 2 = 1 or pid like 'ach_transfer_%')")
def ach_open_batches(spark, d):
    """Bank-transfer batches that may explain a deposit: marked so in their metadata or by their id, without a deposit, settled in the 14 days up to its day."""
    b = V.payout_batches(spark, d).where("processor = 'authorize_net'")
    k, day = F.col("k"), F.lit("1996-06-30").cast("date")
    b = b.withColumn("metadata", F.when((F.col("payout_type") == "ach") & (k % 2 == 1), F.to_json(F.struct(F.lit("ach_transfer").alias("payout_type")))).otherwise("{}"))
    b = b.withColumn("payout", F.when(k % 5 == 0, F.concat(F.lit("ach_transfer_"), k.cast("string"))).otherwise(F.col("processor_payout_id"))).withColumn("deposit_id", F.when(k % 7 == 0, "dep"))
    marked = (F.get_json_object("metadata", "$.payout_type") == "ach_transfer") | F.col("payout").like("ach_transfer_%")
    return b.where(F.col("settlement_date").between(F.date_sub(day, 14), day) & F.col("deposit_id").isNull() & marked).select("k", "settlement_date")


@query("select p.k, o.accounting_id from proc p left join outc o using (workspace_id, processor_payment_id) where (p.workspace_id, p.processor, p.processor_payout_id) in (select (workspace_id, processor, processor_payout_id) from batches where status = 'complete')")
def payments_for_payouts(spark, d):
    """Facts of many payouts at once with their outcomes: a semi-join, then a left join."""
    wanted = V.payout_batches(spark, d).where("status = 'complete'").select(*P.KEYS)
    o = V.outcomes(spark, d).select("workspace_id", "processor_payment_id", "accounting_id")
    return V.processor_facts(spark, d).join(wanted, P.KEYS, "left_semi").join(o, ["workspace_id", "processor_payment_id"], "left").select("k", "accounting_id")


@query("select b.k, b.k % 13 <> 0 payments_valid, b.k % 19 <> 0 refunds_valid, b.k % 23 <> 0 or m.details = 0 fees_valid from batches b join (select workspace_id, processor, processor_payout_id, count(*) filter (k % 3 > 0) details from proc group by all) m using (workspace_id, processor, processor_payout_id)")
def component_sums(spark, d):
    """Whether a payout's payments, refunds and fee details add up to its header (some headers are off here); without fee details there is nothing to compare."""
    p = V.processor_facts(spark, d)
    kind = lambda t: F.when(F.col("event_type") == t, F.col("amount_gross")).otherwise(0)
    members = p.select("k", *P.KEYS, kind("payment").alias("payment"), kind("refund").alias("refund"), F.when(F.col("k") % 3 > 0, F.col("k") % 3).alias("fee"))
    sums = members.groupBy(*P.KEYS).agg(F.min("k").alias("k"), F.sum("payment").alias("payments"), F.sum("refund").alias("refunds"), F.sum("fee").alias("fees"))
    k, off = F.col("k"), lambda n, by: F.when(F.col("k") % n == 0, by).otherwise(0)
    header = sums.select(k, "payments", "refunds", "fees", (F.col("payments") + off(13, 5)).alias("gross_amount"), (F.col("refunds") + off(19, 1)).alias("refund_amount"), (F.coalesce("fees", F.lit(0)) + off(23, 2)).alias("fee_amount"))
    return header.select("k", *P.component_checks())


@query("""select k, 'payout_id' problem from batches where k % 31 = 0 union all select k, 'currency' from batches where k % 37 = 0 union all select k, 'status' from batches where k % 29 = 0
union all select k, 'accounting_leak' from batches where k % 41 = 0 union all select k, 'balance' from batches where k % 17 = 0
union all select b.k, 'negative_amount' from batches b join proc p using (workspace_id, processor, processor_payout_id) group by b.k having bool_or(p.k % 43 = 0)
union all select b.k, 'other_processor' from batches b join proc p using (workspace_id, processor, processor_payout_id) group by b.k having bool_or(p.k % 47 = 0)""")
def payout_contract(spark, d):
    """A row for each rule that a payout breaks: required fields, a currency of three letters, no accounting terms in its metadata, its balance, and components of the same processor with amounts not below zero."""
    k = F.col("k")
    parts = V.processor_facts(spark, d).select(*P.KEYS, F.when(k % 43 == 0, -1).otherwise(F.col("amount_gross")).alias("amount"), F.when(k % 47 == 0, "other").otherwise(F.col("processor")).alias("of"))
    parts = parts.groupBy(*P.KEYS).agg(F.min("amount").alias("least"), F.count_if(F.col("of") != F.col("processor")).alias("strangers"))
    b = V.payout_batches(spark, d).join(parts, P.KEYS).withColumns({
        "payout": F.when(k % 31 != 0, F.col("processor_payout_id")).otherwise(""), "currency": F.when(k % 37 == 0, "US").otherwise("USD"), "state": F.when(k % 29 != 0, F.col("status")),
        "metadata": F.when(k % 41 == 0, '{"QBO_deposit_id":"7"}').otherwise('{"note":"n"}'), "net": F.col("net_amount") - F.when(k % 17 == 0, 1).otherwise(0),
    })
    rules = {
        "payout_id": F.coalesce("payout", F.lit("")) == "", "currency": F.length(F.coalesce("currency", F.lit(""))) != 3, "status": F.col("state").isNull(),
        "accounting_leak": F.contains(F.lower("metadata"), F.lit("qbo_")), "balance": F.abs(F.col("gross_amount") - F.col("fees") - F.col("net")) >= 0.01,
        "negative_amount": F.col("least") < 0, "other_processor": F.col("strangers") > 0,
    }
    return K.broken(b, rules).select("k", "problem")


@query("""select c_custkey, case when c_acctbal > 0 then 'active' else 'ended' end licence, credential, coalesce(connections, 0) connections, s_name configuration from customer
left join (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) filter (o_orderstatus = 'F') credential, count(*) filter (o_orderstatus = 'O') connections from orders group by 1) on o_custkey = c_custkey left join supplier on s_suppkey = c_custkey""", head=False)
def workspace_context(spark, d):
    """What a run needs to know of each workspace: licence, newest active credential, active connections, configuration; null where there is none."""
    c, s = V.table(spark, d, "customer"), V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("configuration"))
    newest = F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey")))
    o = V.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(newest.alias("credential"), F.count_if(F.col("o_orderstatus") == "O").alias("connections"))
    return c.join(o, "c_custkey", "left").join(s, "c_custkey", "left").select("c_custkey", F.when(F.col("c_acctbal") > 0, "active").otherwise("ended").alias("licence"), "credential", F.coalesce("connections", F.lit(0)).alias("connections"), "configuration")


@query(f"""select 'job' kind, cast(job_id as varchar) subject, case when retry_count < max_retries then 'requeue' else 'fail' end as action from jobs where status in ('CLAIMED', 'RUNNING') and heartbeat_at < timestamp '{NOW}' - interval 5 minute
union all select 'run', workspace_id || '/' || sync_run_id, 'close' from (select distinct workspace_id, sync_run_id from jobs j where status = 'COMPLETED' and not exists (select 1 from jobs r where r.workspace_id = j.workspace_id and r.sync_run_id = j.sync_run_id and r.status in ('CLAIMED', 'RUNNING')))
union all select 'lock', workspace_id || '/' || sync_run_id, 'release' from (select distinct workspace_id, sync_run_id from jobs j where status = 'CANCELLED' and not exists (select 1 from jobs r where r.workspace_id = j.workspace_id and r.sync_run_id = j.sync_run_id and r.status = 'RUNNING'))
union all select 'operation', cast(event_id as varchar), 'expire' from (select *, lead(event_type) over w next_type, lead(ts) over w next_ts from events window w as (partition by user_id order by ts, event_id)) where event_type = 'click' and (next_ts is null or next_ts > ts + interval 30 minute)
union all select 'workspace', workspace_id, 'ready' from jobs group by workspace_id having count(*) filter (status in ('CLAIMED', 'RUNNING') and sync_run_id < 2) = 0 and cast(substr(workspace_id, 4) as int) % 3 = 0""")
def recovery_plan(spark, d):
    """What to do after a crash, in one table: stale jobs, then runs, locks, operations and running workspaces that nothing active stands behind."""
    j, keys = V.sync_jobs(spark, d), ["workspace_id", "sync_run_id"]
    row = lambda df, kind, subject, action: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), (F.lit(action) if isinstance(action, str) else action).alias("action"))
    of_run = F.concat_ws("/", "workspace_id", F.col("sync_run_id").cast("string"))
    orphans = lambda state, behind: j.where(F.col("status") == state).select(*keys).distinct().join(behind.select(*keys), keys, "left_anti")
    live = j.groupBy("workspace_id").agg(F.count_if(F.col("status").isin("CLAIMED", "RUNNING") & (F.col("sync_run_id") < 2)).alias("active")).where((F.substring("workspace_id", 4, 9).cast("int") % 3 == 0) & (F.col("active") == 0))
    parts = [
        row(C.stale(j, NOW), "job", F.col("job_id").cast("string"), F.col("action")), row(orphans("COMPLETED", C.active(j)), "run", of_run, "close"), row(orphans("CANCELLED", j.where("status = 'RUNNING'")), "lock", of_run, "release"),
        row(K.expired(V.table(spark, d, "events"), "click", 30), "operation", F.col("started").cast("string"), "expire"), row(live, "workspace", F.col("workspace_id"), "ready"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("""select unnest(['# TYPE quillon_events_total counter', 'quillon_events_total' || l || n, '# TYPE quillon_last_user gauge', 'quillon_last_user' || l || u, '# TYPE quillon_event_ids summary', 'quillon_event_ids_count' || l || n, 'quillon_event_ids_sum' || l || s]) line
from (select '{type="' || event_type || '"} ' l, count(*) n, max(user_id) u, sum(event_id) s from events group by event_type)""", head=False)
def metrics_text(spark, d):
    """Counters, gauges and summaries in the text form that a scraper reads, a row a line."""
    e = V.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("user_id").alias("u"), F.sum("event_id").alias("s"))
    tag = F.concat(F.lit('{type="'), "event_type", F.lit('"} '))
    line = lambda name, c: F.concat(F.lit(name), tag, F.col(c).cast("string"))
    lines = [F.lit("# TYPE quillon_events_total counter"), line("quillon_events_total", "n"), F.lit("# TYPE quillon_last_user gauge"), line("quillon_last_user", "u"), F.lit("# TYPE quillon_event_ids summary"), line("quillon_event_ids_count", "n"), line("quillon_event_ids_sum", "s")]
    return e.select(F.explode(F.array(*lines)).alias("line"))


@query("select k, amount_gross from proc where workspace_id = 'ws_2'")
def tenant_scan(spark, d):
    """One tenant's facts from a table with a folder for each: the filter picks the folder, nothing else is read."""
    path = folder_of(spark, "tenants")
    facts = V.processor_facts(spark, d).select("k", "amount_gross", "workspace_id")
    facts.write.partitionBy("workspace_id").parquet(path)
    return spark.read.schema(facts.schema).parquet(path).where("workspace_id = 'ws_2'").select("k", "amount_gross")
