"""Scans, lookups, ids, normalisation and idempotent writes of facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import ids, labels
from quillon.functions import scores as S
from quillon.operators import writes
from quillon.operators.ranges import ids_hashes
from quillon.plans.catalogue import query
from quillon.sources import views as V


@query("select workspace_id, processor_payment_id, amount_gross from proc where event_type in ('refund', 'ach_return')")
def fact_scan_by_type(spark, d):
    return V.processor_facts(spark, d).where(F.col("event_type").isin("refund", "ach_return")).select("workspace_id", "processor_payment_id", "amount_gross")


@query("select k, processor_payment_id, event_type, amount_gross from proc where processor_payment_id = 'tx42'")
def fact_point_lookup(spark, d):
    return V.processor_facts(spark, d).where("processor_payment_id = 'tx42'").select("k", "processor_payment_id", "event_type", "amount_gross")


@query("select processor_payment_id, proc_date, row_number() over (order by proc_date, k) place from proc where processor_payout_id = (select min(processor_payout_id) from proc)")
def fact_by_payout_ordered(spark, d):
    p = V.processor_facts(spark, d)
    first = p.agg(F.min("processor_payout_id").alias("processor_payout_id"))
    return p.join(F.broadcast(first), "processor_payout_id").select("processor_payment_id", "proc_date", F.row_number().over(Window.orderBy("proc_date", "k")).alias("place"))


@query("select workspace_id, event_type, accounting_id, acct_date from acct where event_type in ('payment_observed') and ref_no = ''")
def facts_by_source(spark, d):
    return V.accounting_facts(spark, d).where((F.col("event_type") == "payment_observed") & (F.col("ref_no") == "")).select("workspace_id", "event_type", "accounting_id", "acct_date")


@query("select k, sha256(workspace_id || '|' || processor || '|' || processor_payment_id || '|' || event_type) id from proc")
def canonical_event_id(spark, d):
    return V.processor_facts(spark, d).select("k", ids.event_id(*map(F.col, ("workspace_id", "processor", "processor_payment_id", "event_type"))).alias("id"))


@query("""select k, sha256(workspace_id || '|' || processor || '|' || processor_payment_id || '|' || event_type) one, sha256(workspace_id || '|' || processor || '|' || lower(event_type) || '|' || processor_payment_id) other
from proc where event_type <> 'payment'""")
def processor_canonical_id_dups(spark, d):
    """Two formulas give a transaction two ids."""
    ws, p, t, e = map(F.col, ("workspace_id", "processor", "processor_payment_id", "event_type"))
    return V.processor_facts(spark, d).where(e != "payment").select("k", ids.event_id(ws, p, t, e).alias("one"), ids.processor_id(ws, p, e, t).alias("other"))


@query("select k, sha256(workspace_id || '|qbo|payment|' || accounting_id || '|observed') id from acct where event_type = 'payment_observed'")
def accounting_canonical_id(spark, d):
    return V.accounting_facts(spark, d).where("event_type = 'payment_observed'").select("k", ids.accounting_id(F.col("workspace_id"), F.lit("qbo"), F.lit("Payment"), F.col("accounting_id")).alias("id"))


@query("select k, 'sync:ws:' || workspace_id || ':' || processor || ':' || processor_payment_id key from proc")
def idempotency_key_v2(spark, d):
    return V.processor_facts(spark, d).select("k", ids.idempotency_key("sync", *map(F.col, ("workspace_id", "processor", "processor_payment_id"))).alias("key"))


@query("""select workspace_id, count(*) n, sha256('["' || string_agg(processor_payment_id, '", "' order by processor_payment_id) || '"]') input_hash from proc group by workspace_id""")
def match_run_input_hash(spark, d):
    return ids_hashes(V.processor_facts(spark, d), "workspace_id", F.col("processor_payment_id")).select(F.col("key").alias("workspace_id"), "n", F.col("hash").alias("input_hash"))


@query("""select event_id id, cast(floor(value * 100) as bigint) cents, cast(floor(value * 100) / 100.0 as decimal(18,2)) amount, coalesce(nullif(json_extract_string(props, '$.currency'), ''), 'USD') currency,
coalesce(json_extract_string(props, '$.source.id'), json_extract_string(props, '$.source'), 'none') source, cast(json_extract_string(props, '$.k') as int) k from events where event_type = 'purchase'""", head=False)
def normalize_charge(spark, d):
    """Cents to money, and JSON fields that may be missing, text or object."""
    e = V.table(spark, d, "events").where("event_type = 'purchase'")
    cents = F.floor(F.col("value") * 100).cast("long")
    at = lambda path: F.get_json_object("props", path)
    return e.select(F.col("event_id").alias("id"), cents.alias("cents"), (cents.cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("amount"), F.coalesce(S.blank_to_null(at("$.currency")), F.lit("USD")).alias("currency"), F.coalesce(at("$.source.id"), at("$.source"), F.lit("none")).alias("source"), at("$.k").cast("int").alias("k"))


@query("""select k, 'Refund for ' || processor_payment_id description, amount_gross amount_net, cast(0 as decimal(18,2)) fees from proc where event_type = 'refund'""")
def normalize_refund(spark, d):
    p = V.processor_facts(spark, d).where("event_type = 'refund'")
    return p.select("k", F.concat(F.lit("Refund for "), "processor_payment_id").alias("description"), F.col("amount_gross").alias("amount_net"), F.lit(0).cast("decimal(18,2)").alias("fees"))


_STATES = "['settledSuccessfully','refundSettledSuccessfully','returnedItem','chargeback','voided','expired','neverHeardOf'][k % 7 + 1]"


@query(f"""select k, {_STATES} state, case k % 7 when 1 then 'refund' when 2 then 'ach_return' when 3 then 'chargeback' when 4 then 'voided' when 5 then 'declined' else 'payment' end kind from proc""")
def gateway_status_map(spark, d):
    return _with_state(V.processor_facts(spark, d)).select("k", "state", labels.gateway_kind(F.col("state")).alias("kind"))


def _with_state(p):
    names = ("settledSuccessfully", "refundSettledSuccessfully", "returnedItem", "chargeback", "voided", "expired", "neverHeardOf")
    return p.withColumn("state", F.element_at(F.array(*map(F.lit, names)), (F.col("k") % 7 + 1).cast("int")))


@query("""select processor_payout_id, 'batch_' || processor_payout_id payout, sum(case when k % 7 in (1, 2) then -amount_gross when k % 7 in (0, 6) then amount_gross else 0 end) net
from proc group by 1 having sum(case when k % 7 in (1, 2) then -amount_gross when k % 7 in (0, 6) then amount_gross else 0 end) > 0""")
def batch_signed_total(spark, d):
    """Signed totals of batches; those above zero become payouts."""
    p = _with_state(V.processor_facts(spark, d))
    net = F.sum(labels.signed_amount(labels.gateway_kind(F.col("state")), F.col("amount_gross")))
    return p.groupBy("processor_payout_id").agg(net.alias("net")).where("net > 0").select("processor_payout_id", F.concat(F.lit("batch_"), "processor_payout_id").alias("payout"), "net")


@query("""select sha256(workspace_id || '|' || processor || '|' || processor_payment_id || '|' || event_type) id, workspace_id, event_type, amount_gross, cast(case when event_type = 'payment' then amount_gross - (k % 3) else amount_gross end as decimal(18,2)) amount_net,
proc_date settlement_date, case when event_type = 'payment' then 'Payment ' else 'Refund ' end || processor_payment_id description, '3.0.0' normalization_version from proc where event_type in ('payment', 'refund')""")
def canonicalize_payment(spark, d):
    """Processor rows as facts: content id, net of fees for payments, default description."""
    p = V.processor_facts(spark, d).where(F.col("event_type").isin("payment", "refund"))
    payment = F.col("event_type") == "payment"
    net = F.when(payment, F.col("amount_gross") - F.col("k") % 3).otherwise(F.col("amount_gross")).cast("decimal(18,2)")
    return p.select(ids.event_id(*map(F.col, ("workspace_id", "processor", "processor_payment_id", "event_type"))).alias("id"), "workspace_id", "event_type", "amount_gross", net.alias("amount_net"), F.col("proc_date").alias("settlement_date"), F.concat(F.when(payment, "Payment ").otherwise("Refund "), "processor_payment_id").alias("description"), F.lit("3.0.0").alias("normalization_version"))


@query("""select k, sha256(workspace_id || '|qbo|' || case when event_type = 'refund_observed' then 'refundreceipt' else 'payment' end || '|' || accounting_id || '|observed') id, event_type, amount_gross, acct_date, nullif(trim(ref_no), '') ref_no from acct""")
def canonicalize_observed(spark, d):
    a = V.accounting_facts(spark, d)
    kind = F.when(F.col("event_type") == "refund_observed", "RefundReceipt").otherwise("Payment")
    return a.select("k", ids.accounting_id(F.col("workspace_id"), F.lit("qbo"), kind, F.col("accounting_id")).alias("id"), "event_type", "amount_gross", "acct_date", S.blank_to_null(F.col("ref_no")).alias("ref_no"))


@query("""select event_id, json_extract_string(props, '$.k') k, cast(1 + (event_id % 2) as int) n_kept from events""", head=False)
def metadata_clean(spark, d):
    """Metadata without the keys that belong to matching and status; what else there is stays."""
    e = V.table(spark, d, "events")
    more = F.create_map(*[F.lit(x) for x in ("qbo_id", "1", "match_score", "2", "status", "x", "needs_review", "y", "readiness", "z")])
    note = F.when(F.col("event_id") % 2 == 1, F.create_map(F.lit("note"), F.lit("n"))).otherwise(F.create_map().cast("map<string,string>"))
    kept = labels.clean_metadata(F.map_concat(F.from_json("props", "map<string,string>"), more, note))
    return e.select("event_id", kept["k"].alias("k"), F.size(kept).alias("n_kept"))


@query("select l_orderkey, l_linenumber, l_suppkey, coalesce(nullif(case when l_suppkey % 3 = 0 then '' else 'own' end, ''), s_name) account_name from lineitem left join supplier on l_suppkey = s_suppkey", head=False)
def account_name_enrich(spark, d):
    """Names from a dimension where a row has none. Spark broadcasts the dimension while it is small."""
    line, s = V.table(spark, d, "lineitem"), V.table(spark, d, "supplier")
    own = F.when(F.col("l_suppkey") % 3 == 0, "").otherwise("own")
    return line.join(s, line.l_suppkey == s.s_suppkey, "left").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(S.blank_to_null(own), "s_name").alias("account_name"))


@query("select distinct 'tx' || l_orderkey id from lineitem where 'tx' || l_orderkey not in (select processor_payment_id from proc where k % 8 = 1)")
def idempotent_append(spark, d):
    new = V.table(spark, d, "lineitem").select(F.concat(F.lit("tx"), F.col("l_orderkey").cast("string")).alias("id"))
    old = V.processor_facts(spark, d).where("k % 8 = 1").select(F.col("processor_payment_id").alias("id"))
    return writes.appended(new, old, ["id"])


@query("select user_id, event_type, arg_min(event_id, event_id) event_id, arg_min(value, event_id) value from events group by 1, 2", head=False)
def insert_or_ignore(spark, d):
    return writes.first_wins(V.table(spark, d, "events"), ["user_id", "event_type"], "event_id", ["value"])


@query("select user_id, max(event_id) event_id, arg_max(event_type, event_id) event_type, arg_max(value, event_id) value from events group by 1", head=False)
def latest_outcome_upsert(spark, d):
    return writes.latest(V.table(spark, d, "events"), ["user_id"], "event_id", ["event_type", "value"])


@query("""select o_custkey, p.workspace_id, p.processor, count(*) confirmations, min(o_orderdate) first_confirmed_at, max(o_orderdate) last_confirmed_at, arg_max(o_orderkey, o_orderkey) last_event
from orders join proc p on p.k = o_orderkey group by all""")
def confirmed_pair_upsert(spark, d):
    o, p = V.table(spark, d, "orders"), V.processor_facts(spark, d).select("k", "workspace_id", "processor")
    return o.join(p, o.o_orderkey == p.k).groupBy("o_custkey", "workspace_id", "processor").agg(F.count(F.lit(1)).alias("confirmations"), F.min("o_orderdate").alias("first_confirmed_at"), F.max("o_orderdate").alias("last_confirmed_at"), F.max_by("o_orderkey", "o_orderkey").alias("last_event"))


@query("""select event_id, case event_id % 8 when 0 then 'infrastructure' when 1 then 'authorization' when 2 then 'infrastructure' when 3 then 'configuration' when 4 then 'data_integrity' when 5 then 'authorization' when 6 then 'data_integrity' else 'infrastructure' end category,
case when event_id % 8 in (0, 2, 7) then [5, 30, 120][least(event_id % 4, 2) + 1] end retry_after from events""", head=False)
def error_taxonomy(spark, d):
    """Classes of error texts by words tried in order, and the wait before a retry of those that pass."""
    texts = ("HTTP 429 rate limit", "401 Unauthorized", "connection timed out", "Account not found", "duplicate key", "token mismatch", "value already exists", "odd")
    e = V.table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int")).alias("text"))
    wait = F.element_at(F.array(*map(F.lit, (5, 30, 120))), (F.least(F.col("event_id") % 4, F.lit(2)) + 1).cast("int"))
    return e.withColumn("category", labels.error_class(F.col("text"))).select("event_id", "category", F.when(F.col("category") == "infrastructure", wait).alias("retry_after"))


@query("select k, (k % 4) || '.' || (k % 11) || '.' || (k % 3) || 'b' version, (k % 4 > 2 or k % 4 = 2 and (k % 11 > 5 or k % 11 = 5 and k % 3 >= 1)) compatible from proc")
def semver_compare(spark, d):
    k = F.col("k")
    p = V.processor_facts(spark, d).select("k", F.concat_ws(".", (k % 4).cast("string"), (k % 11).cast("string"), F.concat((k % 3).cast("string"), F.lit("b"))).alias("version"))
    return p.withColumn("compatible", labels.version_key(F.col("version")) >= labels.version_key(F.lit("2.5.1")))


@query("select distinct processor_payout_id, 'By quillon-' || right(processor_payout_id, 8) stamp from proc")
def deposit_stamp(spark, d):
    return V.processor_facts(spark, d).select("processor_payout_id").distinct().withColumn("stamp", labels.deposit_stamp(F.col("processor_payout_id")))


@query("""select c_custkey, case when c_custkey % 4 = 1 then case c_custkey % 3 when 0 then 'America/Vancouver' when 1 then 'America/St_Johns' else 'America/Toronto' end when c_custkey % 4 = 2 then case c_custkey % 3 when 0 then 'Australia/Perth' when 1 then 'Australia/Darwin' else 'Australia/Sydney' end when c_custkey % 4 = 3 then 'Europe/London' else 'America/New_York' end zone from customer""", head=False)
def timezone_map(spark, d):
    """Time zones by country and state, with a default for each country and one for all."""
    k = F.col("c_custkey")
    pick = lambda of, values: F.element_at(F.array(*map(F.lit, values)), (of + 1).cast("int"))
    state = F.when(k % 4 == 1, pick(k % 3, ("bc ", "NL", "??"))).when(k % 4 == 2, pick(k % 3, ("WA", "nt", "")))
    return V.table(spark, d, "customer").select("c_custkey", labels.zone(pick(k % 4, ("US", "CA", "AU", "GB")), state).alias("zone"))


@query("select event_type metric, count(*) counter, arg_max(value, ts) gauge, round(sum(value), 4) hist_sum from events group by 1", head=False)
def metrics_rollup(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("counter"), F.max_by("value", "ts").alias("gauge"), F.round(F.sum("value"), 4).alias("hist_sum"))
