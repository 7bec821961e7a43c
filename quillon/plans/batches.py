"""Payout batches: totals, balance, readiness, posting plans, and the ranking of bank-transfer explanations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import ach as A
from quillon.operators import posting as P
from quillon.plans.catalogue import query
from quillon.sources import views as V


@query("""select processor_payout_id, sum(case when event_type = 'payment' then amount_gross else 0 end) gross, sum(case when event_type = 'refund' then amount_gross else 0 end) refunds,
sum(case event_type when 'payment' then amount_gross when 'refund' then -amount_gross else 0 end) net, count(*) n from proc group by 1""")
def payout_totals(spark, d):
    return P.totals(V.processor_facts(spark, d))


@query("""select k, cast(gross_amount - fees - coalesce(refunds, 0) - net off as decimal(18,2)) as off from (select b.*, net_amount - coalesce(refunds, 0) - case when k % 29 = 0 then 1 else 0 end net, refunds from batches b left join (select workspace_id, processor, processor_payout_id, sum(amount_gross) refunds from proc where event_type = 'refund' group by all) using (workspace_id, processor, processor_payout_id))
where abs(gross_amount - fees - coalesce(refunds, 0) - net) >= 0.01""".replace(" net off as", " net as"))
def payout_balance_violations(spark, d):
    """Headers whose net isn't gross less fees and refunds; in every 29th the net is wrong by one."""
    refunds = V.processor_facts(spark, d).where("event_type = 'refund'").groupBy(*P.KEYS).agg(F.sum("amount_gross").alias("refunds"))
    b = V.payout_batches(spark, d).join(refunds, P.KEYS, "left").withColumn("refunds", F.coalesce("refunds", F.lit(0)))
    b = b.withColumn("net", F.col("net_amount") - F.col("refunds") - F.when(F.col("k") % 29 == 0, 1).otherwise(0))
    return P.unbalanced(b).select("k", "off")


@query("""select b.k, b.gross_amount - m.gross off from batches b join (select workspace_id, processor, processor_payout_id, sum(amount_gross) gross from proc group by all) m using (workspace_id, processor, processor_payout_id) where abs(b.gross_amount - m.gross) >= 0.01""")
def payout_sum_validation(spark, d):
    keys = ["workspace_id", "processor", "processor_payout_id"]
    members = V.processor_facts(spark, d).groupBy(*keys).agg(F.sum("amount_gross").alias("gross"))
    return V.payout_batches(spark, d).join(members, keys).where(F.abs(F.col("gross_amount") - F.col("gross")) >= 0.01).select("k", (F.col("gross_amount") - F.col("gross")).alias("off"))


_READY = """, m as (select workspace_id, processor, processor_payout_id, count(*) n, count(*) filter (o.accounting_id is not null) matched, count(*) filter (o.match_type = 'pending') pending
from proc p left join outc o using (workspace_id, processor_payment_id) group by all)"""


@query(_READY + " select k, b.processor_payout_id, n from batches b join m using (workspace_id, processor, processor_payout_id) where status = 'complete' and posting_plan_id is null and n = payment_count")
def payouts_ready_v1(spark, d):
    return P.readiness(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)).where("status = 'complete' and posting_plan_id is null and n = payment_count").select("k", "processor_payout_id", "n")


@query(_READY + " select k, b.processor_payout_id, matched from batches b join m using (workspace_id, processor, processor_payout_id) where status = 'complete' and posting_plan_id is null and n = payment_count and matched = n")
def payouts_ready_v3(spark, d):
    return P.readiness(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)).where("status = 'complete' and posting_plan_id is null and n = payment_count and matched = n").select("k", "processor_payout_id", "matched")


@query(_READY + " select k, matched, pending, n - matched unmatched from batches b join m using (workspace_id, processor, processor_payout_id) where status <> 'posted' and (pending > 0 or n > matched)")
def payouts_needing_review(spark, d):
    r = P.readiness(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d))
    return r.where("status <> 'posted' and (pending > 0 or n > matched)").select("k", "matched", "pending", (F.col("n") - F.col("matched")).alias("unmatched"))


@query("select posting_plan_id, k, net_amount from batches where posting_plan_id is not null and status <> 'posted' and k % 4 < 3")
def pending_plans(spark, d):
    """Plans not posted that may be tried again."""
    return V.payout_batches(spark, d).where(F.col("posting_plan_id").isNotNull() & (F.col("status") != "posted") & (F.col("k") % 4 < F.lit(3))).select("posting_plan_id", "k", "net_amount")


LINES_SQL = """, ln as (select b.k, 'payment' kind, p.amount_gross amount, o.accounting_id linked from batches b join proc p using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) where p.event_type = 'payment'
union all select b.k, case when o.accounting_id is not null then 'refund' else 'refund_account' end, -p.amount_gross, o.accounting_id from batches b join proc p using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) where p.event_type = 'refund'
union all select b.k, 'return', -p.amount_gross, null from batches b join proc p using (workspace_id, processor, processor_payout_id) where p.event_type = 'ach_return'
union all select k, 'fee', -fees, null from batches where fees > 0)"""


@query(LINES_SQL + " select k, kind, cast(amount as decimal(18,2)) amount, linked from ln")
def posting_lines(spark, d):
    return P.lines(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d))


@query(LINES_SQL + " select k, count(*) n_lines, sum(amount) total from ln group by k")
def posting_plan_totals(spark, d):
    return P.plans(P.lines(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)), V.payout_batches(spark, d)).select("k", "n_lines", "total")


@query(LINES_SQL + " select b.k, sum(amount) - net_amount off from ln join batches b using (k) group by b.k, net_amount having abs(sum(amount) - net_amount) > 0.01")
def posting_plan_invalid(spark, d):
    return P.plans(P.lines(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)), V.payout_batches(spark, d)).where("abs(off) > 0.01").select("k", "off")


_WIN = """, dep as (select workspace_id, deposit_id, deposit_date, cast(sum(amount) as decimal(18,2)) total_amount from dep_lines group by all),
win as (select d.deposit_id, b.k, b.workspace_id, b.processor_payout_id, b.gross_amount, cast(b.gross_amount - total_amount as double) fee, deposit_date - settlement_date as days from dep d join batches b on b.workspace_id = d.workspace_id and b.payout_type = 'ach' and settlement_date between deposit_date - 14 and deposit_date)"""
_RANK = _WIN + """, per as (select b.k, 100.0 * (count(nullif(customer_email, '')) + count(nullif(customer_name, ''))) / (2 * count(*)) identity, count(*) filter (event_type = 'payment') > 0 and count(*) filter (event_type = 'payment' and o.accounting_id is null) = 0 eligible
  from batches b join proc p using (workspace_id, processor, processor_payout_id) left join outc o using (workspace_id, processor_payment_id) group by b.k),
uq as (select k, count(*) over (partition by workspace_id order by gross_amount range between 15 preceding and 15 following) n from batches where payout_type = 'ach'),
r as (select deposit_id, k, eligible, case when fee < 0 then 0 when fee <= 10 then 100 when fee <= 25 then 90 when fee <= 50 then 75 when fee <= 100 then 60 else greatest(0, 50 - (fee - 100)) end amount_score,
 case when days < 0 then 0 when days between 5 and 10 then 100 when days between 3 and 14 then 80 when days between 1 and 20 then 50 else 20 end date_score, identity, case n when 1 then 100 when 2 then 50 else 20 end uniqueness from win join per using (k) join uq using (k))"""


@query(_WIN + " select deposit_id, k, days from win")
def ach_batch_window(spark, d):
    return A.window(V.deposits(spark, d), V.payout_batches(spark, d)).select("deposit_id", "k", "days")


@query(_RANK + " select deposit_id, k, cast(amount_score as double) amount_score, cast(date_score as double) date_score from r")
def ach_scores(spark, d):
    return A.window(V.deposits(spark, d), V.payout_batches(spark, d)).select("deposit_id", "k", "amount_score", "date_score")


@query(_RANK + " select k, identity, eligible from per")
def ach_eligibility(spark, d):
    """Whether all payments of a batch are matched, and how many members carry an e-mail or a name."""
    return A.members(V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d))


@query(_RANK + " select k, n from uq")
def ach_uniqueness_band(spark, d):
    """Batches of a workspace within 15 of a batch's gross, counted by cells of amounts."""
    return A.band(V.payout_batches(spark, d)).select("k", "n")


@query(_RANK + """, s as (select deposit_id, k, eligible, round(0.7 * amount_score + 0.15 * date_score + 0.1 * identity + 0.05 * uniqueness, 6) score from r)
select deposit_id, k, eligible, score, row_number() over (partition by deposit_id order by eligible desc, score desc, k) rank from s""")
def ach_ranked(spark, d):
    b, p, o = V.payout_batches(spark, d), V.processor_facts(spark, d), V.outcomes(spark, d)
    return A.ranked(V.deposits(spark, d), b, p, o)


@query("""select workspace_id, proc_date transfer_date, sum(case when event_type = 'payment' then amount_gross else 0 end) payments, sum(case when event_type = 'refund' then amount_gross else 0 end) refunds, count(distinct processor_payout_id) n_batches from proc where payment_method = 'bank_account' group by 1, 2""")
def ach_group_by_date(spark, d):
    p = V.processor_facts(spark, d).where("payment_method = 'bank_account'")
    of = lambda kind: F.sum(F.when(F.col("event_type") == kind, F.col("amount_gross")).otherwise(0))
    return p.groupBy("workspace_id", F.col("proc_date").alias("transfer_date")).agg(of("payment").alias("payments"), of("refund").alias("refunds"), F.count_distinct("processor_payout_id").alias("n_batches"))


@query("""select processor_payout_id, 'ach_transfer_' || proc_date payout_id, sum(amount_gross) gross, list_sort(list(processor_payment_id))[1:5] sample from proc where payment_method = 'bank_account' group by processor_payout_id, proc_date""")
def ach_payout_build(spark, d):
    p = V.processor_facts(spark, d).where("payment_method = 'bank_account'")
    keys = ["processor_payout_id", "proc_date"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("processor_payment_id"))  # ranks stop at five in each task
    sample = p.withColumn("_i", first).where("_i <= 5").groupBy(*keys).agg(F.array_sort(F.collect_list("processor_payment_id")).alias("sample"))
    return p.groupBy(*keys).agg(F.sum("amount_gross").alias("gross")).join(sample, keys).select("processor_payout_id", F.concat(F.lit("ach_transfer_"), F.col("proc_date").cast("string")).alias("payout_id"), "gross", "sample")
