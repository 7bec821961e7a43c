"""Bodies as facts, plans of bank transfers, decisions of engine A, and totals of statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import ids, labels
from quillon.functions import scores as S
from quillon.operators import ach as A
from quillon.operators import control as C
from quillon.operators import matching as M
from quillon.operators import posting as P
from quillon.plans.batches import _RANK, LINES_SQL
from quillon.plans.catalogue import query
from quillon.sources import bodies as B
from quillon.sources import processors as X
from quillon.sources import views as V

_BANK = LINES_SQL + """, bb as (select k, case when k % 3 = 0 then 0 else (k % 50) / 10.0 end fee, case when k % 4 = 0 then null else gross_amount - (k % 3) end expected from batches where payout_type = 'ach'),
bl as (select k, kind, amount, linked from ln semi join bb using (k) where kind <> 'fee' union all select k, 'ach_fee', -fee, null from bb where fee > 0),
ba as (select * from bl union all select k, 'settlement_change', expected - coalesce(s, 0), null from bb left join (select k, sum(amount) s from bl group by k) using (k) where abs(expected - coalesce(s, 0)) > 0.001)"""


@query(_BANK + " select k, kind, cast(amount as decimal(18,2)) amount, linked from ba")
def ach_posting_lines(spark, d):
    """Plan lines of bank-transfer batches, with the confirmed fee and what makes them up to the deposit expected."""
    b, k = V.payout_batches(spark, d), F.col("k")
    bank = b.where("payout_type = 'ach'").withColumn("ach_fees", F.when(k % 3 == 0, 0).otherwise((k % 50) / 10)).withColumn("expected_deposit", F.when(k % 4 != 0, F.col("gross_amount") - k % 3))
    return P.bank_lines(bank, P.lines(b, V.processor_facts(spark, d), V.outcomes(spark, d)))


@query(_BANK + " select k, cast(sum(amount) as decimal(18,2)) total, cast(expected as decimal(18,2)) expected from ba join bb using (k) group by k, expected")
def ach_posting_totals(spark, d):
    """Plans of bank transfers add up to the deposit expected, where there is one."""
    b, k = V.payout_batches(spark, d), F.col("k")
    lines = ach_posting_lines(spark, d).groupBy("k").agg(F.sum("amount").cast("decimal(18,2)").alias("total"))
    return lines.join(b.select("k", F.when(k % 4 != 0, F.col("gross_amount") - k % 3).cast("decimal(18,2)").alias("expected")), "k")


@query(""", p as (select * from proc where event_type = 'payment'), a as (select *, case when k % 13 <> 0 then acct_date end adate from acct where event_type = 'payment_observed'),
s as (select p.workspace_id, p.processor_payment_id, a.accounting_id, count(*) over w n, least(100, 40 + case when adate is null or abs(adate - proc_date) <= 3 then 25 when abs(adate - proc_date) <= 7 then 12 else 0 end + case when p.customer_email = a.customer_email then 20 else 0 end
  + case when count(*) over w = 1 then 25 else 0 end) score from p join a on a.workspace_id = p.workspace_id and a.amount_gross = p.amount_gross window w as (partition by p.processor_payment_id)),
t as (select *, max(score) over (partition by processor_payment_id) top from s),
b as (select processor_payment_id, n, top, count(*) > 1 tie, min(accounting_id) id from t where score = top group by all)
select workspace_id, processor_payment_id, coalesce(n, 0) n_candidates, coalesce(top, 0) score, coalesce(tie, false) has_tie, case when n is null then 'no_candidates' when top >= 85 and workspace_id <> 'ws_3' and not tie then 'matched' else 'needs_review' end status,
  case when top >= 85 and workspace_id <> 'ws_3' and not tie then id end accounting_id from p left join b using (processor_payment_id)""")
def engine_a_decisions(spark, d):
    """Engine A on every payment: matched, to review or without candidates. Every thirteenth row has no date; a workspace has matching switched off."""
    p = V.processor_facts(spark, d).where("event_type = 'payment'")
    a = V.accounting_facts(spark, d).where("event_type = 'payment_observed'").withColumn("acct_date", F.when(F.col("k") % 13 != 0, F.col("acct_date")))
    return M.decide_a(p, a, F.col("workspace_id") != "ws_3")


@query(_RANK + """, ob as (select k from batches where payout_type = 'ach' and (k % 2 = 1 or k % 5 = 0) and k % 7 <> 0), od as (select deposit_id from dep where day(deposit_date) % 3 <> 0),
s as (select deposit_id, k, eligible, round(0.7 * amount_score + 0.15 * date_score + 0.1 * identity + 0.05 * uniqueness, 6) score from r join ob using (k) join od using (deposit_id)),
n as (select *, row_number() over (partition by deposit_id order by eligible desc, score desc, k) rank from s)
select deposit_id, 'pending' status, count(*) n_candidates, count(*) filter (eligible) n_eligible, min(k) filter (rank = 1) best, string_agg(k, ',' order by rank) candidates from n group by 1""")
def ach_review_items(spark, d):
    """A review item for each deposit that is still open: the open batches marked as bank transfers, ranked; nothing is matched by itself."""
    k = F.col("k")
    b = V.payout_batches(spark, d).withColumn("marked", (k % 2 == 1) | (k % 5 == 0)).withColumn("deposit", F.when(k % 7 == 0, "dep"))
    open_deposits = V.deposits(spark, d).withColumn("status", F.when(F.dayofmonth("deposit_date") % 3 == 0, "linked").otherwise("open")).where("status = 'open'")
    return A.review_items(A.ranked(open_deposits, b, V.processor_facts(spark, d), V.outcomes(spark, d), F.col("marked") & F.col("deposit").isNull()))


@query("""select sha256(workspace_id || '|' || processor || '|' || processor_payment_id || '|' || event_type) id, event_type, amount_gross, proc_date settlement_date, case when k % 3 = 0 then 'note ' || k when event_type = 'payment' then 'Payment ' || processor_payment_id else 'Refund ' || processor_payment_id end description,
'order' || k order_ref, cast(1 + (k % 2) as int) n_metadata from proc where event_type in ('payment', 'refund') and k % 31 <> 0""")
def canonical_bodies(spark, d):
    """Processor transactions as facts with their metadata: kinds that have no fact fall out, keys of matching and status are cleaned from the metadata, a description stands in where there is none."""
    p, k = V.processor_facts(spark, d), F.col("k")
    kind = F.when(k % 31 == 0, "adjustment").when(F.col("event_type") == "payment", "charge").otherwise(F.col("event_type"))
    meta = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("order"), F.concat(F.lit("order"), k.cast("string"))), F.struct(F.lit("match_status"), F.lit("open")), F.when(k % 2 == 1, F.struct(F.lit("channel"), F.lit("web"))))))
    t = p.select("*", kind.alias("kind"), meta.alias("metadata"), F.when(k % 3 == 0, F.concat(F.lit("note "), k.cast("string"))).alias("note"))
    fact = F.element_at(F.create_map(F.lit("charge"), F.lit("payment"), F.lit("payment"), F.lit("payment"), F.lit("refund"), F.lit("refund")), F.col("kind"))
    t = t.withColumn("fact", fact).where("fact is not null").withColumn("metadata", labels.clean_metadata(F.col("metadata")))
    text = F.concat(F.when(F.col("fact") == "payment", "Payment ").otherwise("Refund "), "processor_payment_id")
    return t.select(ids.event_id(F.col("workspace_id"), F.col("processor"), F.col("processor_payment_id"), F.col("fact")).alias("id"), F.col("fact").alias("event_type"), "amount_gross", F.col("proc_date").alias("settlement_date"), F.coalesce(S.blank_to_null(F.col("note")), text).alias("description"), F.col("metadata")["order"].alias("order_ref"), F.size("metadata").alias("n_metadata"))


@query("""select sha256(workspace_id || '|qbo|' || case when event_type = 'payment_observed' then 'payment' when k % 3 = 0 then 'creditmemo' else 'refundreceipt' end || '|' || accounting_id || '|observed') id, event_type, case when event_type = 'payment_observed' then 'Payment' when k % 3 = 0 then 'CreditMemo' else 'RefundReceipt' end object_type,
amount_gross amount, case when k % 4 = 0 then 'CAD' else 'USD' end currency, nullif(trim(customer_name), '') customer, case when event_type = 'refund_observed' and k % 3 = 0 then 'doc' || k else nullif(trim(ref_no), '') end ref_no, acct_date from acct""")
def observed_bodies(spark, d):
    """Accounting objects' nested bodies as facts: payments, refund receipts and credit memos, whose number is another field."""
    return B.observed_rows(B.observed_bodies(V.accounting_facts(spark, d)))


@query("""select deposit_id, txn_type, txn_id, amount, description from (select deposit_id, case when k % 5 = 0 then 'DirectLine' else txn_type end txn_type, case when k % 5 <> 0 then txn_id end txn_id, amount, case when k % 5 <> 0 then '' when k % 2 = 0 then 'Direct deposit line' else 'cash ' || k end description from dep_lines)""")
def deposit_line_bodies(spark, d):
    """Lines of deposits' bodies: a row for each link, or one direct line where there is none."""
    lines = V.deposit_facts(spark, d)
    return B.deposit_line_rows(B.deposit_bodies(lines))


@query("""select k, case when k % 2 = 0 then 'bank_account' else 'card' end as method, case when k % 2 = 1 then 'visa' end brand, lpad(cast(k % 10000 as varchar), 4, '0') last4, amount_gross amount, nullif(trim(customer_name), '') who, case when k % 3 = 0 then customer_email end email, 'Transaction ' || k description from proc""")
def gateway_transactions(spark, d):
    """Gateway transactions from detail answers (namespaced, with payment and billing elements) and list answers (flat): one row shape, each value from where it is."""
    return B.gateway_transactions(B.gateway_answers(V.processor_facts(spark, d)))


@query("""select k, k % 3 <> 2 is_bank, k % 3 <> 2 and (k % 5 in (0, 1, 3)) is_fee from proc""")
def ach_classifiers(spark, d):
    """Bank transfers by account type or bank account, and the fees among them by description or type."""
    k = F.col("k")
    t = V.processor_facts(spark, d).select("k", F.when(k % 3 == 0, "eCheck").when(k % 3 == 1, None).otherwise("Visa").alias("account"), (k % 3 == 1).alias("bank"), F.when(k % 5 == 0, "monthly FEE").when(k % 5 == 1, "service charge").otherwise("invoice").alias("text"), F.when(k % 5 == 3, "Adjustment").otherwise("capture").alias("type"))
    bank = F.coalesce(F.lower("account") == "echeck", F.lit(False)) | F.col("bank")
    return t.select("k", bank.alias("is_bank"), (bank & (labels.is_fee(F.col("text")) | F.lower("type").rlike("fee|adjustment"))).alias("is_fee"))


@query("select processor, state, count(*) n, count(*) filter (state in ('paid', 'complete', 'settledSuccessfully')) complete from (select processor, case when processor = 'stripe' then case k % 3 when 0 then 'paid' when 1 then 'in_transit' else 'failed' end when k % 2 = 0 then case status when 'complete' then 'complete' else status end else case k % 3 when 0 then 'settledSuccessfully' else 'pendingSettlement' end end state from batches) group by all")
def payout_states(spark, d):
    """Payouts by state, and how many are complete: paid, complete, or settled as the gateway has it."""
    b, k = V.payout_batches(spark, d), F.col("k")
    state = F.when(F.col("processor") == "stripe", F.when(k % 3 == 0, "paid").when(k % 3 == 1, "in_transit").otherwise("failed")).when(k % 2 == 0, F.col("status")).otherwise(F.when(k % 3 == 0, "settledSuccessfully").otherwise("pendingSettlement"))
    done = F.col("state").isin("paid", "complete", "settledSuccessfully")
    return b.select("processor", state.alias("state")).groupBy("processor", "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(done).alias("complete"))


@query("select p.workspace_id, count(*) total_facts, count(*) filter (match_type = 'auto') auto, count(*) filter (match_type = 'pending') pending, count(*) filter (match_type = 'unmatched') unmatched, max(proc_date) last_at from proc p left join outc o using (processor_payment_id) group by 1")
def sync_status_totals(spark, d):
    """A workspace's sync at a glance: all facts, outcomes by kind as columns, the newest fact."""
    both = V.processor_facts(spark, d).join(V.outcomes(spark, d).select("processor_payment_id", "match_type"), "processor_payment_id", "left")
    of = lambda kind: F.count_if(F.col("match_type") == kind).alias(kind)
    return both.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total_facts"), of("auto"), of("pending"), of("unmatched"), F.max("proc_date").alias("last_at"))


@query("""select k, n > 0 and m = n eligible, case when n = 0 then 'No transactions found in batch' when m < n then (n - m) || ' of ' || n || ' transactions not matched' else 'All transactions matched' end reason
from (select b.k, count(p.k) n, count(o.accounting_id) m from batches b left join proc p on p.workspace_id = b.workspace_id and p.processor = b.processor and p.processor_payout_id = b.processor_payout_id and p.event_type = 'payment' left join outc o using (processor_payment_id) where b.payout_type = 'ach' group by b.k)""")
def ach_eligibility_reasons(spark, d):
    """Whether a bank-transfer batch may explain a deposit, and why not."""
    b = V.payout_batches(spark, d).where("payout_type = 'ach'").select("k", *P.KEYS)
    p = V.processor_facts(spark, d).where("event_type = 'payment'").select(*P.KEYS, "processor_payment_id").join(V.outcomes(spark, d).select("processor_payment_id", "accounting_id"), "processor_payment_id", "left")
    n, m = F.count("processor_payment_id").alias("n"), F.count("accounting_id").alias("m")
    reason = F.when(F.col("n") == 0, "No transactions found in batch").when(F.col("m") < F.col("n"), F.format_string("%d of %d transactions not matched", F.col("n") - F.col("m"), "n")).otherwise("All transactions matched")
    return b.join(p, P.KEYS, "left").groupBy("k").agg(n, m).select("k", ((F.col("n") > 0) & (F.col("m") == F.col("n"))).alias("eligible"), reason.alias("reason"))


@query("""select kind, count(*) fetched, count(*) filter (k % 5 = 0) created, count(*) filter (k % 5 <> 0) skipped from (select k, case when event_type = 'refund_observed' then case when k % 3 = 0 then 'CreditMemo' else 'RefundReceipt' end else 'Payment' end kind from acct union all select day(deposit_date), 'Deposit' from (select distinct deposit_id, deposit_date from dep_lines)) group by 1""")
def accounting_counters_by_type(spark, d):
    """Objects that an accounting sync fetched, created and skipped as known, for each of the four types."""
    k = F.col("k")
    a = V.accounting_facts(spark, d).select("k", F.when(F.col("event_type") != "refund_observed", "Payment").when(k % 3 == 0, "CreditMemo").otherwise("RefundReceipt").alias("kind"), F.col("accounting_id").alias("id"))
    fetched = a.unionByName(V.deposits(spark, d).select(F.dayofmonth("deposit_date").cast("long").alias("k"), F.lit("Deposit").alias("kind"), F.col("deposit_id").alias("id")))
    known = fetched.where("k % 5 <> 0").select("kind", "id", F.lit(True).alias("known"))
    return fetched.join(known, ["kind", "id"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("known").isNull()).alias("created"), F.count("known").alias("skipped"))


@query("""select * from (select 'single_running' as invariant, count(*) violations from (select workspace_id from jobs where status = 'RUNNING' group by workspace_id having count(*) > 1)
union all select 'retries', count(*) from jobs where retry_count >= max_retries and status = 'QUEUED' union all select 'auto_threshold', count(*) from outc where match_type = 'auto' and match_confidence < 85) where violations > 0""")
def invariant_totals(spark, d):
    """How many rows break each invariant."""
    return C.violations(V.sync_jobs(spark, d), V.outcomes(spark, d)).groupBy("invariant").agg(F.count(F.lit(1)).alias("violations"))


@query("""select o.k, coalesce(p.processor, 'unknown') processor, coalesce(p.customer_email, p.customer_name, 'r' || o.k) customer, p.amount_gross amount from outc o left join (select * from proc where k % 8 <> 0) p using (processor_payment_id) where match_type = 'pending'""")
def review_facts(spark, d):
    """Open reviews with the facts that they are about; every eighth fact is gone, and what it would give stands in."""
    o = V.outcomes(spark, d).where("match_type = 'pending'").select("k", "processor_payment_id")
    p = V.processor_facts(spark, d).where("k % 8 <> 0").select("processor_payment_id", "processor", "customer_email", "customer_name", "amount_gross")
    who = F.coalesce("customer_email", "customer_name", F.concat(F.lit("r"), F.col("k").cast("string")))
    return o.join(p, "processor_payment_id", "left").select("k", F.coalesce("processor", F.lit("unknown")).alias("processor"), who.alias("customer"), F.col("amount_gross").alias("amount"))


_LIC = """apps as (select n_nationkey app_id, n_name app, n_regionkey > 0 enabled from nation), lic as (select c_custkey workspace, c_nationkey app_id, case when c_acctbal > 0 then 'active' else 'lapsed' end status, date '2024-01-01' + cast(c_custkey % 60 as int) until from customer where c_custkey % 4 <> 0)"""


@query(f"with {_LIC} select c_custkey workspace, app, coalesce(status = 'active' and until >= date '2024-01-20' and enabled, false) entitled, case when lic.workspace is null then 'no_licence' when status <> 'active' then 'lapsed' when until < date '2024-01-20' then 'expired' when not enabled then 'app_off' else 'ok' end reason from customer left join lic on lic.workspace = c_custkey left join apps using (app_id)", head=False)
def entitlements(spark, d):
    """Workspaces with their licences and the apps that these are for: whether they may use them, and the first reason against it."""
    n, c = V.table(spark, d, "nation"), V.table(spark, d, "customer")
    apps = n.select(F.col("n_nationkey").alias("app_id"), F.col("n_name").alias("app"), (F.col("n_regionkey") > 0).alias("enabled"))
    lic = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("workspace"), F.col("c_nationkey").alias("app_id"), F.when(F.col("c_acctbal") > 0, "active").otherwise("lapsed").alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 60).cast("int")).alias("until"))
    j = c.select(F.col("c_custkey").alias("workspace")).join(lic, "workspace", "left").join(apps, "app_id", "left")
    ends = F.lit("2024-01-20").cast("date")
    reason = F.when(F.col("status").isNull(), "no_licence").when(F.col("status") != "active", "lapsed").when(F.col("until") < ends, "expired").when(~F.col("enabled"), "app_off").otherwise("ok")
    return j.select("workspace", "app", (reason == "ok").alias("entitled"), reason.alias("reason"))


@query("""select finding, name, count(*) n from (select 'unexpected' finding, unnest(list_filter(case when k % 9 = 0 then ['id', 'amount', 'match_score'] when k % 10 = 0 then ['id', 'match_status'] else ['id', 'amount'] end, lambda x: x not in ('id', 'amount'))) as name from proc
union all select 'missing', 'amount' from proc where k % 9 <> 0 and k % 10 = 0) group by all""")
def body_schema_findings(spark, d):
    """Keys that facts' bodies lack or have beyond what was agreed, row by row: names of matching and status must not be among them."""
    k = F.col("k")
    body = F.when(k % 9 == 0, F.to_json(F.struct(k.alias("id"), F.col("amount_gross").alias("amount"), F.lit(1).alias("match_score")))).when(k % 10 == 0, F.to_json(F.struct(k.alias("id"), F.lit("x").alias("match_status")))).otherwise(F.to_json(F.struct(k.alias("id"), F.col("amount_gross").alias("amount"))))
    wanted, found = F.array(F.lit("id"), F.lit("amount")), F.json_object_keys(body)
    each = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("finding"), x.alias("name")))
    rows = V.processor_facts(spark, d).select(F.inline(F.concat(each("unexpected", F.array_except(found, wanted)), each("missing", F.array_except(wanted, found)))))
    return rows.groupBy("finding", "name").agg(F.count(F.lit(1)).alias("n"))


def _raw(spark, d):
    """Raw objects of both processors as they are kept, one table; some kinds that no processor knows."""
    p, b = V.processor_facts(spark, d), V.payout_batches(spark, d)
    mine = lambda df, name: df.where(F.col("processor") == name)
    part = lambda df, processor, kind, id_: df.select(F.lit(processor).alias("processor"), F.lit(kind).alias("object"), id_.cast("string").alias("id"), "body")
    none = F.lit("")
    return (
        part(B.charge_bodies(mine(p, "stripe")), "stripe", "charge", F.concat(F.lit("tx"), F.col("k").cast("string")))
        .union(part(B.payout_bodies(mine(b, "stripe")), "stripe", "payout", none)).union(part(B.balance_bodies(mine(p, "stripe")), "stripe", "balance", F.col("processor_payout_id")))
        .union(part(B.gateway_answers(mine(p, "authorize_net")), "authorize_net", "transaction", none)).union(part(B.gateway_bodies(mine(p, "authorize_net")), "authorize_net", "listed", F.col("k")))
        .union(part(B.gateway_bodies(mine(p, "stripe")), "other", "listed", F.col("k")))
    )


@query("""select processor, case when processor = 'stripe' then 'tx' || k else '' || k end payment_id, amount_gross amount, case when processor = 'stripe' then case when payment_method is null or payment_method = 'card' then 'card' else 'bank_account' end when k % 2 = 0 then 'bank_account' else 'card' end as method,
case when processor = 'stripe' then coalesce(customer_email, 'r' || k || '@x.org') when k % 3 = 0 then customer_email end email from proc""")
def processor_payments(spark, d):
    """Payments of all processors in one shape, each through the interface that its processor implements."""
    return X.normalised(_raw(spark, d), "payments")


@query("""select processor, payout_id, count(*) n, sum(amount) total from (select processor, processor_payout_id payout_id, amount_gross amount from proc where processor = 'stripe' union all select processor, 'b' || (k % 50), case when k % 20 = 1 then -amount_gross else amount_gross end from proc where processor = 'authorize_net') group by all""")
def processor_members(spark, d):
    """What payouts consist of, by either processor's answers."""
    return X.normalised(_raw(spark, d), "members").groupBy("processor", "payout_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))


@query("select c_custkey, case when c_custkey % 3 = 2 then 'unknown' when c_custkey % 3 = 0 and c_nationkey % 2 = 0 then 'api_key' when c_custkey % 3 = 1 and c_nationkey % 4 = 0 then 'login_id' when c_custkey % 3 = 1 and c_nationkey % 4 = 1 then 'transaction_key' end problem from customer", head=False)
def processor_settings(spark, d):
    """What is wrong with the settings of workspaces, as their processors see it."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    settings = F.create_map(F.lit("api_key"), F.when(n % 2 == 0, "pk_x").otherwise("sk_x"), F.lit("login_id"), F.when(n % 4 == 0, " ").otherwise("me"), F.lit("transaction_key"), F.when(n % 4 != 1, "key"))
    w = V.table(spark, d, "customer").select("c_custkey", F.when(c % 3 == 0, "stripe").when(c % 3 == 1, "authorize_net").otherwise("paper").alias("processor"), settings.alias("settings"))
    return X.problems(w).select("c_custkey", "problem")
