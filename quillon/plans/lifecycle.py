"""Lookups, normalisers, reviews, posting and control decisions over logs and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import ids, labels
from quillon.operators import commits as C
from quillon.operators import posting as P
from quillon.operators import writes
from quillon.plans.batches import LINES_SQL
from quillon.plans.catalogue import query
from quillon.sources import bodies as B
from quillon.sources import views as V
from quillon.sources.scratch import folder_of, kept

NOW = "2024-01-20 12:00:00"


@query("select k, proc_date from proc where workspace_id = 'ws_1' and processor = 'stripe' and processor_payment_id in ('tx2', 'tx4', 'tx42', 'tx100') order by proc_date")
def facts_of_transaction(spark, d):
    """Facts by workspace, processor and transaction, oldest first."""
    return V.processor_facts(spark, d).where("workspace_id = 'ws_1' and processor = 'stripe' and processor_payment_id in ('tx2', 'tx4', 'tx42', 'tx100')").orderBy("proc_date").select("k", "proc_date")


@query("select accounting_id, event_type, acct_date, row_number() over (partition by workspace_id, acct_date order by event_type desc, accounting_id desc) place from acct where event_type in ('payment_observed', 'refund_observed')")
def facts_by_source_ordered(spark, d):
    """Facts of an IN list of types, newest first by two keys; the place is within a day, so no task sorts a workspace."""
    w = Window.partitionBy("workspace_id", "acct_date").orderBy(F.col("event_type").desc(), F.col("accounting_id").desc())
    return V.accounting_facts(spark, d).where(F.col("event_type").isin("payment_observed", "refund_observed")).select("accounting_id", "event_type", "acct_date", F.row_number().over(w).alias("place"))


@query("select k, accounting_id from acct where event_type = 'payment_observed' and accounting_id in (select 'q' || l_orderkey from lineitem where l_quantity > 45)")
def facts_by_source_id(spark, d):
    """Facts of given source ids: the content id is computed anew from each, then a semi-join on it."""
    fact_id = lambda ws, obj: ids.accounting_id(F.col(ws), F.lit("qbo"), F.lit("Payment"), F.col(obj))
    a = V.accounting_facts(spark, d).where("event_type = 'payment_observed'").withColumn("id", fact_id("workspace_id", "accounting_id"))
    asked = V.table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("q"), F.col("l_orderkey").cast("string")).alias("obj")).distinct()
    workspaces = V.processor_facts(spark, d).select(F.concat(F.lit("q"), F.col("k").cast("string")).alias("obj"), "workspace_id")
    wanted = asked.join(workspaces, "obj").select(fact_id("workspace_id", "obj").alias("id"))
    return a.join(wanted, "id", "left_semi").select("k", "accounting_id")


def _snapshot(spark, d):
    """Accounting objects as a source would leave them: JSON bodies, a folder for each year of update."""
    a = V.accounting_facts(spark, d)
    line = F.struct(F.array(F.struct(F.col("accounting_id").alias("TxnId"), F.when(F.col("k") % 4 == 0, "Deposit").otherwise("Invoice").alias("TxnType"))).alias("LinkedTxn"), F.col("amount_gross").cast("string").alias("Amount"))
    body = F.to_json(F.struct(F.col("accounting_id").alias("Id"), F.col("amount_gross").cast("string").alias("TotalAmt"), F.col("acct_date").cast("string").alias("TxnDate"), F.nullif(F.col("ref_no"), F.lit("")).alias("PaymentRefNum"), F.array(line).alias("Line")))
    path = folder_of(spark, "snapshot")
    a.select("k", body.alias("body"), F.col("acct_date").alias("updated"), F.year("acct_date").alias("year")).write.partitionBy("year").parquet(path)
    return spark.read.schema("k long, body string, updated date, year int").parquet(path)


_BODY = "Id string, TotalAmt string, TxnDate date, PaymentRefNum string, Line array<struct<LinkedTxn:array<struct<TxnId:string,TxnType:string>>,Amount:string>>"


@query("select accounting_id, amount_gross amount, acct_date, nullif(ref_no, '') ref from acct where acct_date >= date '1998-01-01'")
def accounting_updated_since(spark, d):
    """Objects updated since a day: the filter picks folders, bodies are read with a fixed schema."""
    b = _snapshot(spark, d).where("year >= 1998 and updated >= date '1998-01-01'").select(F.from_json("body", _BODY).alias("b"))
    return b.select(F.col("b.Id").alias("accounting_id"), F.col("b.TotalAmt").cast("decimal(18,2)").alias("amount"), F.col("b.TxnDate").alias("acct_date"), F.col("b.PaymentRefNum").alias("ref"))


@query("select accounting_id, amount_gross amount from acct where accounting_id in (select 'q' || o_orderkey from orders where o_orderpriority = '1-URGENT')")
def accounting_object_fetch(spark, d):
    """Single objects by id, as a semi-join against the accounting facts."""
    asked = V.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("accounting_id"))
    b = V.accounting_facts(spark, d).select("accounting_id", F.col("amount_gross").alias("amount"))
    return b.join(asked, "accounting_id", "left_semi")


@query("select accounting_id, k % 4 = 0 in_deposit from acct where acct_date >= date '1997-06-01' and (k % 4 <> 0 or k % 8 = 0)")
def unlinked_objects(spark, d):
    """Objects since a day without a link to a deposit, read from nested lines; workspaces that ask for linked ones too (every second here) get them."""
    b = _snapshot(spark, d).where("year >= 1997 and updated >= date '1997-06-01'").select("k", F.from_json("body", _BODY).alias("b"))
    linked = F.exists(F.flatten(F.transform("b.Line", lambda x: x["LinkedTxn"])), lambda t: t["TxnType"] == "Deposit")
    return b.select(F.col("b.Id").alias("accounting_id"), linked.alias("in_deposit"), (F.col("k") % 8 == 0).alias("include_linked")).where("not in_deposit or include_linked").drop("include_linked")


@query("select accounting_id, accounting_id txn_id, case when k % 4 = 0 then 'Deposit' else 'Invoice' end txn_type, amount_gross amount from acct")
def nested_links(spark, d):
    """Line[].LinkedTxn[] flattened to a row a link, with the line's amount."""
    b = _snapshot(spark, d).select(F.from_json("body", _BODY).alias("b")).select(F.col("b.Id").alias("accounting_id"), F.explode("b.Line").alias("line"))
    return b.select("accounting_id", F.col("line.Amount").cast("decimal(18,2)").alias("amount"), F.inline("line.LinkedTxn").alias("txn_id", "txn_type")).select("accounting_id", "txn_id", "txn_type", "amount")


@query("select id, object_type from raw where cast(captured_at as date) between date '2024-01-03' and date '2024-01-09'")
def raw_events_between(spark, d):
    """The range is on the column as it is stored, so that row groups can be skipped."""
    at = F.col("captured_at")
    return V.raw_objects(spark, d).where((at >= F.lit("2024-01-03").cast("timestamp")) & (at < F.lit("2024-01-10").cast("timestamp"))).select("id", "object_type")


_REV = ", rev as (select k, workspace_id, processor_payment_id, accounting_id, match_confidence from outc where match_type = 'pending')"


def _reviews(spark, d):
    o = V.outcomes(spark, d).where("match_type = 'pending'")
    candidates = F.to_json(F.array(F.struct(F.col("accounting_id").alias("id"), F.col("match_confidence").alias("score")), F.struct(F.lit("none").alias("id"), F.lit(10).alias("score"))))
    return o.select("k", "workspace_id", "processor_payment_id", "accounting_id", "match_confidence", candidates.alias("candidates"))


@query(_REV + " select k, accounting_id best, match_confidence score from rev order by k limit 50")
def pending_reviews(spark, d):
    """The fifty oldest open reviews, with the best of the candidates that each keeps as JSON."""
    r = _reviews(spark, d).orderBy("k").limit(50).withColumn("c", F.from_json("candidates", "array<struct<id:string,score:int>>"))
    best = F.array_max(F.transform("c", lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))))
    return r.select("k", best["id"].alias("best"), best["score"].alias("score"))


@query("select k, '[{\"id\":\"' || accounting_id || '\",\"score\":' || match_confidence || '},{\"id\":\"none\",\"score\":10}]' candidates from outc where match_type = 'pending'")
def candidates_json(spark, d):
    """Candidates as they are kept with a review."""
    return _reviews(spark, d).select("k", "candidates")


@query("select k, strftime(proc_date, '%Y-%m-%d') || 'T00:00:00Z' stamp, '{\"id\":\"' || processor_payment_id || '\",\"amount\":\"' || amount_gross || '\"}' body from proc where event_type = 'refund'")
def json_safe_rows(spark, d):
    """Rows for a JSON answer: ISO stamps, decimals as text."""
    return V.processor_facts(spark, d).where("event_type = 'refund'").select("k", F.date_format(F.col("proc_date").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.to_json(F.struct(F.col("processor_payment_id").alias("id"), F.col("amount_gross").cast("string").alias("amount"))).alias("body"))


_PAIR = ", pair as (select o_custkey, p.workspace_id, p.processor, coalesce(p.payment_method, '') method, o_orderkey, o_orderdate from orders join proc p on p.k = o_orderkey)"
_PAIR_KEYS = ["o_custkey", "workspace_id", "processor", "method"]


def _confirmed(spark, d):
    p = V.processor_facts(spark, d).select("k", "workspace_id", "processor", F.coalesce("payment_method", F.lit("")).alias("method"))
    return V.table(spark, d, "orders").join(p, F.col("o_orderkey") == F.col("k"))


@query(_PAIR + " select o_custkey, workspace_id, processor, method, count(*) n, min(o_orderdate) first_at, max(o_orderdate) last_at, arg_min(o_orderkey, (o_orderdate, o_orderkey)) first_event, arg_max(o_orderkey, (o_orderdate, o_orderkey)) last_event from pair group by 1, 2, 3, 4")
def confirmed_pairs(spark, d):
    """Confirmed pairs by their four keys, with a counter and the first and last event: one aggregate."""
    at = F.struct("o_orderdate", "o_orderkey")
    return _confirmed(spark, d).groupBy(*_PAIR_KEYS).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.min(at)["o_orderkey"].alias("first_event"), F.max(at)["o_orderkey"].alias("last_event"))


@query(_PAIR + ", old as (select distinct o_custkey, workspace_id, processor, method from pair where o_orderdate < timestamp '1997-01-01') select pair.o_orderkey, old.o_custkey is not null known from pair left join old using (o_custkey, workspace_id, processor, method) where pair.o_orderdate >= timestamp '1997-01-01'")
def confirmed_pair_lookup(spark, d):
    """Whether a new fact's four keys were confirmed before."""
    c = _confirmed(spark, d)
    cut = F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")
    old = c.where(cut).select(*_PAIR_KEYS).distinct().withColumn("known", F.lit(True))
    return c.where(~cut).join(old, _PAIR_KEYS, "left").select("o_orderkey", F.coalesce("known", F.lit(False)).alias("known"))


@query("""select 'batches' tbl, count(*) n, cast(sum(gross_amount) as decimal(18,2)) total, 1 runs from batches union all select 'outcomes', count(*), cast(sum(match_confidence) as decimal(18,2)), 1 from outc
union all select 'reviews', count(*), cast(sum(match_confidence) as decimal(18,2)), 1 from outc where match_type = 'pending'""")
def run_tables(spark, d):
    """Batches, outcomes and reviews of a run, from one stored match result, written apart and made visible together; a second try adds nothing."""
    folder = folder_of(spark, "run")
    result, batches = kept(V.outcomes(spark, d), "result"), V.payout_batches(spark, d)
    tables = {"batches": batches.select("k", F.col("gross_amount").alias("value")), "outcomes": result.select("k", F.col("match_confidence").cast("decimal(18,2)").alias("value")), "reviews": result.where("match_type = 'pending'").select("k", F.col("match_confidence").cast("decimal(18,2)").alias("value"))}
    done = [C.commit(spark, folder, "run-1", tables) for _ in range(2)]
    out = None
    for name, df in tables.items():
        n = C.visible(spark, folder, name, df.schema).agg(F.count(F.lit(1)).alias("n"), F.sum("value").cast("decimal(18,2)").alias("total")).select(F.lit(name).alias("tbl"), "n", "total", F.lit(sum(done)).alias("runs"))
        out = n if out is None else out.union(n)
    return out


@query("select workspace_id, object_type, processor_object_id, count(*) n, count(distinct md5(raw_json)) bodies from raw group by 1, 2, 3 having count(*) > 1")
def raw_duplicates(spark, d):
    """Keys that a unique insert of raw events would refuse, and how many checksums each has."""
    return V.raw_objects(spark, d).groupBy("workspace_id", "object_type", "processor_object_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.md5("raw_json")).alias("bodies")).where("n > 1")


@query("select object_type, processor_object_id, min(id) id from raw where object_type in ('purchase', 'click') and workspace_id <> 'ws_3' and (object_type, processor_object_id) not in (select (object_type, processor_object_id) from raw where captured_at < timestamp '2024-01-05') and captured_at >= timestamp '2024-01-05' group by 1, 2")
def raw_persist(spark, d):
    """Raw objects to store: of types on the list, in workspaces with the flag on, not stored before, once each."""
    r, cut = V.raw_objects(spark, d), F.lit("2024-01-05").cast("timestamp")
    new = r.where(F.col("object_type").isin("purchase", "click") & (F.col("workspace_id") != "ws_3") & (F.col("captured_at") >= cut))
    keys = ["object_type", "processor_object_id"]
    return new.groupBy(*keys).agg(F.min("id").alias("id")).join(r.where(F.col("captured_at") < cut).select(*keys), keys, "left_anti")


@query("select p.k, case when p.payment_method = 'bank_account' and b.k % 3 = 0 then 'ready' when p.payment_method = 'bank_account' then 'ach' else 'card' end section, case when b.k % 3 = 0 and p.payment_method = 'bank_account' then b.net_amount end expected from proc p join batches b using (workspace_id, processor, processor_payout_id)")
def ach_intents(spark, d):
    """Bank transfers of batches for which a user has entered a deposit amount move to ready."""
    b = V.payout_batches(spark, d)
    intents = b.where("k % 3 = 0").select(*P.KEYS, F.col("net_amount").alias("amount"))
    p = V.processor_facts(spark, d).join(b.select(*P.KEYS), P.KEYS).join(intents, P.KEYS, "left")
    ach = F.col("payment_method").eqNullSafe("bank_account")
    return p.select("k", F.when(ach & F.col("amount").isNotNull(), "ready").when(ach, "ach").otherwise("card").alias("section"), F.when(ach, F.col("amount")).alias("expected"))


@query("select k, processor_payment_id, accounting_id from outc where match_type = 'pending' and k % 3 = 0")
def review_confirmed_pairs(spark, d):
    """Accepted reviews write a confirmed pair, once however often they are accepted."""
    r = _reviews(spark, d)
    decisions = r.where("k % 3 = 0").select(F.col("k").alias("dk"), F.explode(F.array(F.lit("accept"), F.lit("accept"))).alias("decision"))
    accepted = decisions.where("decision = 'accept'").select("dk").distinct()
    return r.join(accepted, r.k == accepted.dk, "left_semi").select("k", "processor_payment_id", "accounting_id")


@query("select k, case when k % 5 = 0 and payment_count > 1 then 'confirmed' when k % 5 = 1 then 'rejected' else 'pending' end state, case when k % 5 = 0 and payment_count > 1 then 'ready_for_deposit' else status end batch_status from batches where payout_type = 'ach'")
def ach_review_lifecycle(spark, d):
    """Reviews of bank-transfer batches with the decisions on them: only an eligible one (here of two payments or more) can be confirmed, and that marks its batch."""
    b = V.payout_batches(spark, d).where("payout_type = 'ach'")
    log = b.select(F.col("k").alias("dk"), F.when(F.col("k") % 5 == 0, "confirm").when(F.col("k") % 5 == 1, "reject").alias("decision")).where("decision is not null")
    j = b.join(log, b.k == log.dk, "left")
    state = F.when((F.col("decision") == "confirm") & (F.col("payment_count") > 1), "confirmed").when(F.col("decision") == "reject", "rejected").otherwise("pending")
    return j.withColumn("state", state).select("k", "state", F.when(F.col("state") == "confirmed", "ready_for_deposit").otherwise(F.col("status")).alias("batch_status"))


@query("select k, case when k % 20 = 0 then 'posted' when k % 30 = 10 then 'failed' else 'created' end state, case when k % 20 = 0 then 3 when k % 30 = 10 then 2 else 1 end version from batches where posting_plan_id is not null")
def plan_lifecycle(spark, d):
    """The latest state of posting plans, from a log of their changes."""
    b = V.payout_batches(spark, d).where("posting_plan_id is not null").select("k")
    entry = lambda n, s: F.struct(F.lit(n).alias("version"), F.lit(s).alias("state"))
    log = b.select("k", F.inline(F.array_compact(F.array(entry(1, "created"), F.when(F.col("k") % 20 == 0, entry(2, "approved")), F.when((F.col("k") % 30 == 10) & (F.col("k") % 20 != 0), entry(2, "failed")), F.when(F.col("k") % 20 == 0, entry(3, "posted"))))))
    return writes.latest(log, ["k"], "version", ["state"]).select("k", "state", "version")


@query("select user_id, count(*) events, max(event_id) last_event, case arg_max(event_type, event_id) when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end state from events group by 1", head=False)
def operation_fold(spark, d):
    """An idempotent operation's state, folded from its events."""
    e = V.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("t"))
    return e.select("user_id", "events", "last_event", F.when(F.col("t") == "purchase", "completed").when(F.col("t") == "error", "failed").otherwise("pending").alias("state"))


@query("select k, case when processor = 'stripe' and event_type = 'payment' then 'charge' when processor = 'stripe' and event_type = 'refund' then 'refund' when processor = 'authorize_net' and event_type <> 'ach_return' and k % 9 <> 0 then 'gateway' end normaliser, case when not (processor = 'authorize_net' and (k % 9 = 0 or event_type = 'ach_return')) and not (processor = 'stripe' and event_type = 'ach_return') then amount_gross end amount from proc")
def dispatch_normalise(spark, d):
    """The normaliser of a raw row by processor and category: null for kinds that none knows and for bodies that can't be read."""
    p = V.processor_facts(spark, d)
    body = F.when((F.col("processor") == "authorize_net") & (F.col("k") % 9 == 0), "not a number").otherwise(F.col("amount_gross").cast("string"))
    amount = body.try_cast("decimal(18,2)")
    kind = F.when((F.col("processor") == "stripe") & (F.col("event_type") == "payment"), "charge").when((F.col("processor") == "stripe") & (F.col("event_type") == "refund"), "refund").when((F.col("processor") == "authorize_net") & (F.col("event_type") != "ach_return"), "gateway")
    ok = kind.isNotNull() & amount.isNotNull()
    return p.select("k", F.when(ok, kind).alias("normaliser"), F.when(ok, amount).alias("amount"))


@query("select k, amount_gross amount, 'tx' || k charge, case when k % 3 = 0 then 'pending' else 'succeeded' end status, 'Refund of tx' || k description, proc_date from proc where event_type = 'refund'")
def refund_rows(spark, d):
    """Refund bodies in JSON as rows; the charge is an id or an object."""
    return B.refund_rows(B.refund_bodies(V.processor_facts(spark, d).where("event_type = 'refund'")))


@query("select sha256(workspace_id || '|' || processor || '|' || processor_payout_id || '|fee') id, k, 'fee' event_type, fees amount_gross, -fees amount_net, 'Processing fee for ' || processor_payout_id description from batches where fees > 0")
def canonicalize_fee(spark, d):
    """Fees of payouts as facts, with a content id of their own."""
    b = V.payout_batches(spark, d).where("fees > 0")
    return b.select(ids.event_id(*map(F.col, ("workspace_id", "processor", "processor_payout_id")), F.lit("fee")).alias("id"), "k", F.lit("fee").alias("event_type"), F.col("fees").alias("amount_gross"), (-F.col("fees")).alias("amount_net"), F.concat(F.lit("Processing fee for "), "processor_payout_id").alias("description"))


@query("select sha256(workspace_id || '|qbo|deposit|' || deposit_id || '|observed') id, deposit_id, cast(sum(amount) as decimal(18,2)) amount_gross, count(*) filter (typed) n_lines, count(*) n_components from dep_lines group by workspace_id, deposit_id")
def canonicalize_deposit(spark, d):
    """Deposits as facts, with what their lines and component ids hold."""
    dep = V.deposits(spark, d)
    return dep.select(ids.accounting_id(F.col("workspace_id"), F.lit("qbo"), F.lit("Deposit"), F.col("deposit_id")).alias("id"), "deposit_id", F.col("total_amount").alias("amount_gross"), F.size("lines").cast("long").alias("n_lines"), F.size("component_payment_ids").cast("long").alias("n_components"))


@query("select k, case event_type when 'payment' then 'charge' else event_type end event_type, cast(amount_gross * 100 as bigint) cents, case when event_type = 'refund' then 'tx' || k end refund_id from proc where event_type <> 'ach_return'")
def replay_canonical(spark, d):
    """Facts as a replay names them: a payment is a charge, amounts in cents."""
    p = V.processor_facts(spark, d).where("event_type <> 'ach_return'")
    return p.select("k", F.when(F.col("event_type") == "payment", "charge").otherwise(F.col("event_type")).alias("event_type"), (F.col("amount_gross") * 100).cast("long").alias("cents"), F.when(F.col("event_type") == "refund", F.col("processor_payment_id")).alias("refund_id"))


@query("select k, amount_gross amount, amount_gross, case when k % 2 = 0 then proc_date else null end payout_date, case when event_type = 'refund' then abs(-amount_gross) else amount_gross end plain from proc")
def alias_sync(spark, d):
    """Two names of one value: whichever is set fills the other; refunds and fees are kept without a sign."""
    p = V.processor_facts(spark, d)
    zero = F.lit(0).cast("decimal(18,2)")
    r = p.select("k", "event_type", F.when(F.col("k") % 3 == 0, zero).otherwise(F.col("amount_gross")).alias("amount"), F.when(F.col("k") % 3 == 1, zero).otherwise(F.col("amount_gross")).alias("amount_gross"), F.when(F.col("k") % 2 == 0, F.col("proc_date")).alias("settlement_date"), F.lit(None).cast("date").alias("payout_date"), F.when(F.col("event_type") == "refund", -F.col("amount_gross")).otherwise(F.col("amount_gross")).alias("signed"))
    full = lambda a, b: F.when((F.col(a) == 0) & (F.col(b) != 0), F.col(b)).otherwise(F.col(a))
    return r.select("k", full("amount", "amount_gross").alias("amount"), full("amount_gross", "amount").alias("amount_gross"), F.coalesce("payout_date", "settlement_date").alias("payout_date"), F.abs("signed").alias("plain"))


@query(LINES_SQL + """ select k, kind, case when linked is not null then '{"Amount":"' || amount || '","LinkedTxn":[{"TxnId":"' || linked || '","TxnType":"' || case when kind = 'refund' then 'RefundReceipt' else 'Payment' end || '"}]}'
else '{"Amount":"' || amount || '","DepositLineDetail":{"AccountRef":"' || case kind when 'fee' then 'fees' when 'return' then 'settlement' else 'refunds' end || '"}}' end body from (select k, kind, cast(amount as decimal(18,2)) amount, linked from ln) where kind <> 'payment' or linked is not null""")
def api_lines(spark, d):
    """Lines as the accounting API takes them: linked to a transaction, or against an account."""
    ln = P.lines(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)).where("kind <> 'payment' or linked is not null")
    amount = F.col("amount").cast("string").alias("Amount")
    linked = F.to_json(F.struct(amount, F.array(F.struct(F.col("linked").alias("TxnId"), F.when(F.col("kind") == "refund", "RefundReceipt").otherwise("Payment").alias("TxnType"))).alias("LinkedTxn")))
    account = F.when(F.col("kind") == "fee", "fees").when(F.col("kind") == "return", "settlement").otherwise("refunds")
    return ln.select("k", "kind", F.when(F.col("linked").isNotNull(), linked).otherwise(F.to_json(F.struct(amount, F.struct(account.alias("AccountRef")).alias("DepositLineDetail")))).alias("body"))
