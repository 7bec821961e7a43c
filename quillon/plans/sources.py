"""Semi-structured sources, text sinks, contract checks, timers and small tables of rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import ids, labels
from quillon.functions import scores as S
from quillon.operators import checks as K
from quillon.operators import deposits as D
from quillon.plans.catalogue import query
from quillon.sources import bodies as B
from quillon.sources import views as V


@query("select k, 'b' || (k % 50) batch, case when k % 20 = 1 then 'refund' else 'payment' end kind, amount_gross amount, lpad(cast(k % 10000 as varchar), 4, '0') last4, case when k % 5 = 0 then 'bank_account' else 'card' end method from proc")
def xml_gateway_parse(spark, d):
    """Gateway answers in XML, read with a fixed schema."""
    return B.gateway_rows(B.gateway_bodies(V.processor_facts(spark, d)))


@query("""select k, cast(amount_gross as decimal(18,2)) amount, 'USD' currency, case when k % 2 = 0 then 'cus' || k else 'obj' || k end customer, coalesce(customer_email, 'r' || k || '@x.org') email, payment_method is null or payment_method = 'card' is_card, proc_date from proc""")
def json_charge_parse(spark, d):
    """Charges in JSON: cents, epoch seconds, a customer that is text or an object, an e-mail with a fallback."""
    return B.charge_rows(B.charge_bodies(V.processor_facts(spark, d)))


@query("select processor_payout_id, count(*) n, sum(amount_gross) gross, sum(case when k % 3 = 0 then 1 else 0 end) fee from proc where processor = 'stripe' group by 1")
def balance_list_explode(spark, d):
    """Lists of balance transactions, one body a payout, exploded and summed."""
    p = V.processor_facts(spark, d).where("processor = 'stripe'")
    return B.balance_rows(B.balance_bodies(p)).groupBy("processor_payout_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("gross"), F.sum("fee").alias("fee"))


@query("select object_type, processor_object_id, max(id) id from raw where sync_run_id = '2024-01-05' group by 1, 2")
def raw_snapshot_of_run(spark, d):
    return V.raw_objects(spark, d).where("sync_run_id = '2024-01-05'").groupBy("object_type", "processor_object_id").agg(F.max("id").alias("id"))


@query("select k, 'missing_email' problem from proc where customer_email is null union all select k, 'low_amount' from proc where amount_gross < 10000 union all select k, 'no_method' from proc where payment_method is null")
def contract_compliance(spark, d):
    """A row for each rule that a fact breaks; one pass over the facts."""
    rules = {"missing_email": F.col("customer_email").isNull(), "low_amount": F.col("amount_gross") < 10000, "no_method": F.col("payment_method").isNull()}
    return K.broken(V.processor_facts(spark, d), rules).select("k", "problem")


@query("""with found as (select column_name from (describe select * from lineitem)), wanted as (select unnest(['l_orderkey', 'l_quantity', 'l_shipdate', 'currency', 'match_score']) column_name)
select column_name, 'missing' finding from wanted where column_name not in (select column_name from found) union all select column_name, 'unexpected' from found where column_name not in (select column_name from wanted)""", head=False)
def schema_compliance(spark, d):
    """Columns that a table lacks or has beyond what was agreed."""
    return K.schema_findings(V.table(spark, d, "lineitem"), {"l_orderkey", "l_quantity", "l_shipdate", "currency", "match_score"})


@query("select 'quillon_events_total{type=\"' || event_type || '\"} ' || count(*) line from events group by event_type", head=False)
def metrics_exposition(spark, d):
    e = V.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.select(F.concat(F.lit('quillon_events_total{type="'), "event_type", F.lit('"} '), F.col("n").cast("string")).alias("line"))


@query("""select '{"job_id":' || job_id || ',"workspace_id":"' || workspace_id || '","status":"' || status || '"}' line from jobs where status = 'FAILED'""")
def json_log_lines(spark, d):
    return V.sync_jobs(spark, d).where("status = 'FAILED'").select(F.to_json(F.struct("job_id", "workspace_id", "status")).alias("line"))


@query("""select c_custkey, part, date '2024-01-01' + cast(31 * part as int) first_day, least(date '2024-01-01' + cast(31 * part as int) + 30, date '2024-01-01' + cast(90 + c_custkey % 40 as int)) last_day
from (select c_custkey, unnest(range(0, (90 + c_custkey % 40) // 31 + 1)) part from customer)""", head=False)
def date_chunks(spark, d):
    """Date ranges cut into pieces of 31 days, both ends included."""
    c = V.table(spark, d, "customer").select("c_custkey", F.lit("2024-01-01").cast("date").alias("a"), F.date_add(F.lit("2024-01-01").cast("date"), (90 + F.col("c_custkey") % 40).cast("int")).alias("b"))
    part = F.explode(F.sequence(F.lit(0), F.floor(F.datediff("b", "a") / 31).cast("int")))
    return c.withColumn("part", part).withColumn("first_day", F.date_add("a", (F.col("part") * 31).cast("int"))).withColumn("last_day", F.least(F.date_add("first_day", 30), F.col("b"))).select("c_custkey", F.col("part").cast("long").alias("part"), "first_day", "last_day")


@query("select distinct txn_id from dep_lines where typed and txn_type = 'RefundReceipt' and txn_id not in (select accounting_id from outc where accounting_id is not null and k % 3 <> 0)")
def missing_refunds(spark, d):
    """Refunds that deposits name and no outcome knows (every third outcome is lost here): what a late pass must fetch."""
    named = D.lines(V.deposits(spark, d)).where("txn_type = 'RefundReceipt'").select("txn_id").distinct()
    return named.join(V.outcomes(spark, d).where("k % 3 <> 0").select(F.col("accounting_id").alias("txn_id")), "txn_id", "left_anti")


@query("select k, cast(fees as decimal(18,2)) fees from batches where (payout_type = 'ach' or processor_payout_id like 'po_3%') and posting_plan_id is null")
def ach_batch_predicate(spark, d):
    return V.payout_batches(spark, d).where(((F.col("payout_type") == "ach") | F.col("processor_payout_id").like("po_3%")) & F.col("posting_plan_id").isNull()).select("k", "fees")


@query("select k, try_cast(case k % 5 when 0 then '12.345' when 1 then ' 7 ' when 2 then 'abc' when 3 then '' else '-3.1' end as decimal(18,2)) amount from proc")
def parse_amounts(spark, d):
    """Amounts from text; what can't be read is null."""
    text = F.element_at(F.array(*map(F.lit, ("12.345", " 7 ", "abc", "", "-3.1"))), (F.col("k") % 5 + 1).cast("int"))
    return V.processor_facts(spark, d).select("k", F.trim(text).try_cast("decimal(18,2)").alias("amount"))


@query("""select k, case k % 6 when 0 then true when 1 then true when 2 then false when 3 then true when 4 then false else true end is_fee from proc where payment_method = 'bank_account'""")
def ach_fee_classifier(spark, d):
    """Fees among bank transfers by words in the description or the type."""
    texts = ("eCheck service FEE", "processing fee 2", "refund", "discount", "invoice", "adjustment of batch")
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("k") % 6 + 1).cast("int"))
    return V.processor_facts(spark, d).where("payment_method = 'bank_account'").select("k", labels.is_fee(t).alias("is_fee"))


@query("""select user_id, event_id started from (select *, lead(event_type) over w next_type, lead(ts) over w next_ts from events window w as (partition by user_id order by ts, event_id))
where event_type = 'click' and (next_ts is null or next_ts > ts + interval 30 minute)""", head=False)
def expired_operations(spark, d):
    """Operations with no follow-up within the 30 minutes that they may stay pending."""
    return K.expired(V.table(spark, d, "events"), "click", 30)


@query("select job_id, scheduled_at + interval 1 minute * [5, 15, 30][retry_count + 1] retry_at, job_id + 100000 retry_id from jobs where status = 'FAILED' and retry_count < max_retries")
def retry_schedule(spark, d):
    wait = F.element_at(F.array(*map(F.lit, (5, 15, 30))), F.col("retry_count") + 1)
    return V.sync_jobs(spark, d).where("status = 'FAILED' and retry_count < max_retries").select("job_id", (F.col("scheduled_at") + F.make_dt_interval(mins=wait)).alias("retry_at"), (F.col("job_id") + 100000).alias("retry_id"))


@query("select workspace_id, h - case when h >= 9223372036854775808 then 18446744073709551616 else 0 end lock from (select distinct workspace_id, cast(cast('0x' || substr(sha256(workspace_id), 1, 16) as ubigint) as hugeint) h from jobs)")
def lock_numbers(spark, d):
    return V.sync_jobs(spark, d).select("workspace_id").distinct().select("workspace_id", ids.lock_number(F.col("workspace_id")).alias("lock"))


@query("select k from (select k, md5(cast(amount_gross as varchar) || event_type) h from proc) a join (select k, md5(cast(case when k % 50 = 7 then amount_gross + 1 else amount_gross end as varchar) || event_type) h from proc) b using (k) where a.h <> b.h")
def immutability_probe(spark, d):
    """Facts whose content differs between two snapshots."""
    p = V.processor_facts(spark, d)
    later = p.withColumn("amount_gross", F.when(F.col("k") % 50 == 7, F.col("amount_gross") + 1).otherwise(F.col("amount_gross")).cast("decimal(18,2)"))
    return K.changed(p, later, "k", ["amount_gross", "event_type"])


@query("select c_custkey, c_acctbal > 0 as licence, c_nationkey % 3 <> 0 as connection, coalesce(n, 0) > 0 as data, case when c_acctbal > 0 and c_nationkey % 3 <> 0 and coalesce(n, 0) > 0 then 'ready' when c_acctbal > 0 then 'pending' else 'blocked' end as state from customer left join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey", head=False)
def activation_status(spark, d):
    c = V.table(spark, d, "customer")
    n = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    out = c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", (F.col("c_acctbal") > 0).alias("licence"), (F.col("c_nationkey") % 3 != 0).alias("connection"), (F.coalesce("n", F.lit(0)) > 0).alias("data"))
    return out.withColumn("state", F.when(F.expr("licence and connection and data"), "ready").when(F.col("licence"), "pending").otherwise("blocked"))


@query("select k, coalesce(nullif(trim(ref_no), ''), 'none') ref, coalesce(nullif(trim(customer_name), ''), customer_email, '?') who from acct")
def blank_fallbacks(spark, d):
    a = V.accounting_facts(spark, d)
    return a.select("k", F.coalesce(S.blank_to_null(F.col("ref_no")), F.lit("none")).alias("ref"), F.coalesce(S.blank_to_null(F.col("customer_name")), "customer_email", F.lit("?")).alias("who"))


@query("select status, count(*) n, count(distinct workspace_id) workspaces from jobs group by grouping sets ((status), ())")
def job_totals_extension(spark, d):
    """Beyond the survey: totals by state and over all, as grouping sets."""
    return V.sync_jobs(spark, d).groupingSets([[F.col("status")], []], "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("workspace_id").alias("workspaces")).select("status", "n", "workspaces")


