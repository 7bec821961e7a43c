"""Matching queries: exact, candidates, the three scores, ranks, ties, sections, deposits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.operators import allocation as B
from quillon.operators import deposits as D
from quillon.operators import matching as M
from quillon.plans.catalogue import query
from quillon.sources import views as V
from quillon.sources.scratch import kept


def _sides(spark, d):
    return V.processor_facts(spark, d).where("event_type = 'payment'"), V.accounting_facts(spark, d).where("event_type = 'payment_observed'")


_CAND = """, p as (select * from proc where event_type = 'payment'), a as (select * from acct where event_type = 'payment_observed'),
c as (select p.*, a.accounting_id, a.ref_no, a.acct_date, a.customer_email acct_email, a.customer_name acct_name, acct_date - proc_date as days, count(*) over (partition by processor_payment_id) n_amount,
  coalesce(ref_no <> '' and ref_no <> processor_payment_id, false) conflict from p join a on p.workspace_id = a.workspace_id and p.amount_gross = a.amount_gross),
asym as (select *, case when days between 0 and 3 then 25 when days between 4 and 7 then 12 when days = -1 then 10 when days between -7 and -2 then 5 else 0 end dp,
  case when abs(days) <= 3 then 25 when abs(days) <= 7 then 12 else 0 end ds, customer_email = acct_email same_email,
  lower(trim(customer_name)) na, lower(trim(acct_name)) nb from c),
ident as (select *, case when same_email then 25 when na = nb then 25 when list_sort(list_filter(string_split(replace(na, ',', ' '), ' '), lambda x: x <> '')) = list_sort(list_filter(string_split(replace(nb, ',', ' '), ' '), lambda x: x <> ''))
  and len(list_filter(string_split(replace(na, ',', ' '), ' '), lambda x: x <> '')) >= 2 then 25 when contains(na, nb) or contains(nb, na) then 12 else 0 end ip from asym),
sc as (select *, least(100, 40 + dp + ip + case when ip > 0 and n_amount = 1 then 10 else 0 end) score from ident where not conflict),
bc as (select *, row_number() over (partition by processor_payment_id order by score desc, acct_date desc, accounting_id) rank, count(*) filter (score = top) over (partition by processor_payment_id) > 1 has_tie
  from (select *, max(score) over (partition by processor_payment_id) top from sc))"""
_EXACT = """, ix as (select * from acct where ref_no <> '' qualify row_number() over (partition by workspace_id, ref_no order by acct_date, accounting_id) = 1)"""


@query(_EXACT + " select p.processor_payment_id, ix.accounting_id, p.amount_gross, ix.amount_gross acct_amount from proc p join ix on p.workspace_id = ix.workspace_id and p.processor_payment_id = ix.ref_no")
def deterministic_match(spark, d):
    return M.by_reference(V.processor_facts(spark, d), V.accounting_facts(spark, d)).select("processor_payment_id", "accounting_id", "amount_gross", "acct_amount")


@query(_EXACT + " select processor_payment_id, accounting_id, accounting_id is not null resolved from proc p left join ix on p.workspace_id = ix.workspace_id and p.processor_payment_id = ix.ref_no")
def resolve_by_ref_no(spark, d):
    p = V.processor_facts(spark, d)
    hit = M.by_reference(p, V.accounting_facts(spark, d)).select("processor_payment_id", "accounting_id")
    return p.select("processor_payment_id").join(hit, "processor_payment_id", "left").withColumn("resolved", F.col("accounting_id").isNotNull())


@query(_CAND + " select processor_payment_id, accounting_id, n_amount, conflict from c")
def amount_candidates(spark, d):
    return M.candidates(*_sides(spark, d), columns=["accounting_id"], own=["processor_payment_id"]).select("processor_payment_id", "accounting_id", "n_amount", "conflict")


@query(_CAND + " select days, dp points, ds symmetric_points, count(*) n from asym group by all")
def date_scores(spark, d):
    return M.day_pairs(*_sides(spark, d)).select("days", S.date_points(F.col("days")).alias("points"), S.date_points_symmetric(F.col("days")).alias("symmetric_points"), "n")


@query(_CAND + " select processor_payment_id, accounting_id, ip points from ident")
def name_identity_score(spark, d):
    c = M.candidates(*_sides(spark, d), columns=["accounting_id", "_b"], own=["processor_payment_id", "_a"])
    return c.select("processor_payment_id", "accounting_id", S.likely_points(F.col("_a"), F.col("_b")).alias("points"))


@query(_CAND + """, s as (select processor_payment_id, accounting_id, least(100, 40 + ds + case when same_email then 20 else 0 end + case when n_amount = 1 then 25 else 0 end) score from asym)
select *, case when score >= 85 then 'high' when score >= 50 then 'medium' else 'low' end level from s""")
def score_engine_a(spark, d):
    return M.scored(M.candidates(*_sides(spark, d), signed=True, columns=["accounting_id", "_b"], own=["processor_payment_id", "_a"], keys=("email",)), "a").select("processor_payment_id", "accounting_id", "score", "level")


@query(_CAND + """, s as (select processor_payment_id, accounting_id, coalesce(same_email, false) identity, least(100, 40 + dp + case when same_email then 10 + case when n_near = 1 then 10 else 0 end else 0 end) score
from (select *, count(*) filter (abs(days) <= 7) over (partition by processor_payment_id) n_near from asym)) select *, case when score >= 80 and identity then 'high' when score >= 50 then 'medium' else 'low' end level from s""")
def score_engine_b(spark, d):
    return M.scored(M.candidates(*_sides(spark, d), signed=True, near=7, columns=["accounting_id", "_b"], own=["processor_payment_id", "_a"], keys=("email",)), "b").select("processor_payment_id", "accounting_id", "identity", "score", "level")


@query(_CAND + " select processor_payment_id, accounting_id, score, case when score >= 80 and ip > 0 then 'high' else 'review' end level from sc")
def score_engine_c(spark, d):
    return M.scored(M.candidates(*_sides(spark, d), columns=["accounting_id", "_b"], own=["processor_payment_id", "_a"]), "c").select("processor_payment_id", "accounting_id", "score", "level")


@query()
def engine_b_run(spark, d):
    """Every payment by engine B: exact references, then the best row used up unless it is a tie."""
    return B.run(*_sides(spark, d))


@query(_EXACT.replace("from acct where", "from acct where event_type = 'payment_observed' and") + """ select p.workspace_id, count(*) payments, count(ix.accounting_id) exact, coalesce(sum(case when ix.amount_gross <> p.amount_gross then 1 else 0 end), 0)::bigint other_amount
from proc p left join ix on p.workspace_id = ix.workspace_id and p.processor_payment_id = ix.ref_no where p.event_type = 'payment' group by 1""")
def engine_b_exact(spark, d):
    """The run's exact part by workspace: payments, those that a row refers to, and how many of these have another amount."""
    p, a = _sides(spark, d)
    hits = B.exact(p, a).select("workspace_id", "processor_payment_id", "accounting_id")
    both = p.join(hits, ["workspace_id", "processor_payment_id"], "left").join(a.select("accounting_id", F.col("amount_gross").alias("theirs")), "accounting_id", "left")
    return both.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("payments"), F.count("accounting_id").alias("exact"), F.count_if(F.col("theirs") != F.col("amount_gross")).alias("other_amount"))


@query(_CAND + " select processor_payment_id, accounting_id, score, has_tie from bc where rank = 1")
def best_candidate(spark, d):
    return M.best_by_keys(*_sides(spark, d)).select("processor_payment_id", "accounting_id", "score", "has_tie")


@query(_CAND + " select score, has_tie, count(*) n from bc where rank = 1 group by all")
def candidate_ties(spark, d):
    return M.best_by_keys(*_sides(spark, d)).groupBy("score", "has_tie").agg(F.count(F.lit(1)).alias("n"))


@query(_CAND + " select processor_payment_id, count(*) filter (k % 3 = 0 or abs(days) <= 7) = 1 unique_near from c group by 1")
def unique_in_window(spark, d):
    """Whether a fact has one candidate within a week; where its date is unknown, as for every third one here, all count."""
    p, a = _sides(spark, d)
    undated = p.withColumn("proc_date", F.when(F.col("k") % 3 != 0, F.col("proc_date")))
    return M.near_counts(undated, a).select("processor_payment_id", (F.col("n_near") == 1).alias("unique_near"))


@query(_CAND + " select processor_payment_id, rank, accounting_id, score from bc where rank <= 5")
def top5_candidates(spark, d):
    return M.top_by_keys(*_sides(spark, d))


@query(_CAND + """, e as (select processor_payment_id from proc p join (select distinct workspace_id, ref_no from acct where event_type = 'payment_observed' and ref_no <> '') x on x.workspace_id = p.workspace_id and x.ref_no = p.processor_payment_id where event_type = 'payment'),
s as (select p.workspace_id, case when p.payment_method = 'bank_account' then 'ach' when e.processor_payment_id is not null or (b.score >= 80 and b.ip > 0) then 'ready' else 'needs_review' end section,
  case when e.processor_payment_id is not null then 100 else coalesce(b.score, 0) end score from p left join e using (processor_payment_id) left join (select * from bc where rank = 1) b using (processor_payment_id))
select workspace_id, section, count(*) n, cast(sum(score) as bigint) total_score from s group by all""")
def match_sections_nongreedy(spark, d):
    """Sections of all payments by their best candidate: two joins, windows, a count."""
    return M.sections(*_sides(spark, d)).groupBy("workspace_id", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total_score"))


def _run(spark, d, operator=M.run):
    """The run in its order: deposits first, then card, bank and refund passes with pools of their own.

    The sides are read some ten times, so they are written first: in one job Spark broadcast the customers once for each, more than the driver holds.
    What deposits explain is written too, so its shuffles are gone when facts are dealt.
    """
    p, a, dep = kept(V.processor_facts(spark, d), "proc"), kept(V.accounting_facts(spark, d), "acct"), kept(V.deposits(spark, d), "deposits")
    explained = kept(D.by_reference(dep, a, p).select("processor_payment_id").union(D.by_amount(dep, a, p).select("processor_payment_id")), "explained")
    return operator(p.where("event_type in ('payment', 'refund')"), a, D.deposited(dep), explained)


@query()
def match_run_greedy(spark, d):
    return _run(spark, d)


@query()
def match_run_summary(spark, d):
    return _run(spark, d).groupBy("pass", "outcome").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


_LEFT = """, dep_ref as (select distinct p.processor_payment_id, p.processor_payout_id, c.deposit_id, c.txn_id from dep_lines c join acct a on a.accounting_id = c.txn_id join proc p on p.workspace_id = c.workspace_id and p.processor_payment_id = a.ref_no),
dep_rest as (select c.deposit_id, c.txn_id, a.amount_gross, row_number() over (partition by c.deposit_id, a.amount_gross order by c.txn_id) n from (select distinct deposit_id, txn_id from dep_lines) c join acct a on a.accounting_id = c.txn_id where c.txn_id not in (select txn_id from dep_ref)),
dep_free as (select b.deposit_id, p.processor_payment_id, p.amount_gross, row_number() over (partition by b.deposit_id, p.amount_gross order by p.processor_payment_id) n from (select distinct deposit_id, processor_payout_id from dep_ref) b join proc p using (processor_payout_id) where p.processor_payment_id not in (select processor_payment_id from dep_ref)),
explained as (select processor_payment_id from dep_ref union select processor_payment_id from dep_rest join dep_free using (deposit_id, amount_gross, n))"""


@query(_LEFT + _EXACT.replace("select * from acct where", "select *, case event_type when 'refund_observed' then 'refund' else 'payment' end kind from acct where").replace("workspace_id, ref_no", "workspace_id, ref_no, event_type") + """, gone as (select distinct txn_id from dep_lines where not typed or txn_type = 'Payment')
select p.processor_payment_id, ix.accounting_id, case when p.event_type = 'refund' then 'refund' when p.payment_method = 'bank_account' then 'ach' else 'card' end "pass" from proc p join ix on p.workspace_id = ix.workspace_id and p.processor_payment_id = ix.ref_no and p.event_type = ix.kind
where p.processor_payment_id not in (select processor_payment_id from explained) and ix.accounting_id not in (select txn_id from gone)""")
def match_run_exact(spark, d):
    """The run's exact matches, the part that SQL can say: no deposit explains the fact, and none holds its accounting fact."""
    return _run(spark, d, M.exact_matches).select("processor_payment_id", "accounting_id", "pass")


@query(_LEFT + """ select case when event_type = 'ach_return' then 'ach' when event_type = 'refund' then 'refund' when payment_method = 'bank_account' then 'ach' else 'card' end pass_name, count(*) n, count(*) filter (event_type = 'ach_return') n_returns from proc where processor_payment_id not in (select processor_payment_id from explained) group by 1""")
def unclassified_facts(spark, d):
    """Facts that no deposit explains, by the pass that they go to; a missing payment method counts as card, and returns go with bank transfers, unmatched."""
    p, a, dep = V.processor_facts(spark, d), V.accounting_facts(spark, d), V.deposits(spark, d)
    explained = D.by_reference(dep, a, p).select("processor_payment_id").union(D.by_amount(dep, a, p).select("processor_payment_id")).distinct()
    kind = F.when(F.col("event_type") == "ach_return", "ach").when(F.col("event_type") == "refund", "refund").when(F.col("payment_method").eqNullSafe("bank_account"), "ach").otherwise("card")
    return p.join(explained, "processor_payment_id", "left_anti").groupBy(kind.alias("pass_name")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "ach_return").alias("n_returns"))


@query("""select k, match_confidence, case when match_confidence >= 85 then 'high' when match_confidence >= 50 then 'medium' else 'low' end level, case when match_confidence >= 85 then 'auto' when match_confidence >= 50 then 'pending' else 'unmatched' end permitted,
match_type = 'auto' and match_confidence < 85 violates from outc""")
def confidence_levels(spark, d):
    """Levels, the match type that they permit, and automatic matches below the threshold."""
    c = F.col("match_confidence")
    permitted = F.when(c >= 85, "auto").when(c >= 50, "pending").otherwise("unmatched")
    return V.outcomes(spark, d).select("k", c, S.level(c, 85).alias("level"), permitted.alias("permitted"), ((F.col("match_type") == "auto") & (c < 85)).alias("violates"))


@query("select deposit_id, txn_type, txn_id, amount from dep_lines where typed")
def deposit_line_items(spark, d):
    return D.lines(V.deposits(spark, d)).select("deposit_id", "txn_type", "txn_id", "amount")


@query("select distinct txn_id from dep_lines where not typed or txn_type = 'Payment'")
def deposited_ids(spark, d):
    return D.deposited(V.deposits(spark, d))


@query("select accounting_id, amount_gross from acct where event_type = 'payment_observed' and accounting_id not in (select txn_id from dep_lines where not typed or txn_type = 'Payment')")
def unlinked_payments(spark, d):
    a = V.accounting_facts(spark, d).where("event_type = 'payment_observed'")
    return a.join(D.deposited(V.deposits(spark, d)), F.col("accounting_id") == F.col("txn_id"), "left_anti").select("accounting_id", "amount_gross")


_COMP = """, comp as (select distinct workspace_id, deposit_id, txn_id from dep_lines), ca as (select comp.*, a.ref_no, a.amount_gross from comp join acct a on a.accounting_id = comp.txn_id),
p1 as (select ca.deposit_id, ca.txn_id, p.processor_payment_id, p.processor_payout_id from ca join proc p on p.workspace_id = ca.workspace_id and p.processor_payment_id = ca.ref_no)"""


@query(_COMP + " select * from p1")
def deposit_components_ref_no(spark, d):
    return D.by_reference(V.deposits(spark, d), V.accounting_facts(spark, d), V.processor_facts(spark, d)).select("deposit_id", "txn_id", "processor_payment_id", "processor_payout_id")


@query(_COMP + """, rest as (select ca.*, row_number() over (partition by deposit_id, amount_gross order by txn_id) n from ca where txn_id not in (select txn_id from p1)),
free as (select b.deposit_id, p.processor_payment_id, p.amount_gross, row_number() over (partition by b.deposit_id, p.amount_gross order by p.processor_payment_id) n
  from (select distinct deposit_id, processor_payout_id from p1) b join proc p using (processor_payout_id) where p.processor_payment_id not in (select processor_payment_id from p1))
select rest.deposit_id, rest.txn_id, free.processor_payment_id from rest join free using (deposit_id, amount_gross, n)""")
def deposit_components_fallback(spark, d):
    """Components without a reference, paired one to one with unclaimed facts of the deposit's payouts and their amount."""
    return D.by_amount(V.deposits(spark, d), V.accounting_facts(spark, d), V.processor_facts(spark, d))


@query("select k, processor_payment_id, case when match_type = 'auto' then 'accepted' when k % 6 = 0 then 'accepted' when k % 6 = 4 then 'rejected' else 'unresolved' end resolution from outc")
def review_resolution(spark, d):
    """Outcomes with the decisions on them, a log joined on."""
    o = V.outcomes(spark, d)
    log = o.where("k % 2 = 0").select(F.col("k").alias("dk"), F.when(F.col("k") % 6 == 0, "accepted").when(F.col("k") % 6 == 4, "rejected").alias("decision"))
    return o.join(log, o.k == log.dk, "left").select("k", "processor_payment_id", F.when(F.col("match_type") == "auto", "accepted").otherwise(F.coalesce("decision", F.lit("unresolved"))).alias("resolution"))


@query("""select p.processor_payment_id, p.amount_gross, o.accounting_id, case when o.accounting_id is null then null when a.event_type = 'refund_observed' then 'RefundReceipt' else 'Payment' end object_type
from proc p left join outc o using (processor_payment_id) left join acct a on a.accounting_id = o.accounting_id""")
def payments_for_payout(spark, d):
    """Facts with their outcomes and the type of the object matched."""
    p, o, a = V.processor_facts(spark, d), V.outcomes(spark, d), V.accounting_facts(spark, d)
    kind = F.when(F.col("accounting_id").isNull(), None).when(F.col("a_type") == "refund_observed", "RefundReceipt").otherwise("Payment")
    return p.join(o.select("processor_payment_id", "accounting_id"), "processor_payment_id", "left").join(a.select("accounting_id", F.col("event_type").alias("a_type")), "accounting_id", "left").select("processor_payment_id", "amount_gross", "accounting_id", kind.alias("object_type"))


@query("""with dep as (select workspace_id, deposit_id, deposit_date, cast(sum(amount) as decimal(18,2)) total_amount from dep_lines group by all), twice as (select * from dep union all select workspace_id, deposit_id || '_again', deposit_date, total_amount + case when day(deposit_date) % 3 = 0 then 1 else 0.01 end from dep)
select a.deposit_id probe, b.deposit_id as found from twice a join twice b on a.workspace_id = b.workspace_id and a.deposit_date = b.deposit_date and abs(a.total_amount - b.total_amount) < 0.02 and a.deposit_id <> b.deposit_id and contains(b.deposit_id, '_again')""".replace("with dep as", ", dep as"))
def duplicate_deposit_probe(spark, d):
    """Deposits of a workspace and date within two hundredths whose memo holds a mark: an equi-join, the rest a filter. Each is here twice, some a whole unit apart."""
    dep = V.deposits(spark, d).select("workspace_id", "deposit_id", "deposit_date", "total_amount")
    step = F.when(F.dayofmonth("deposit_date") % 3 == 0, F.lit(1)).otherwise(F.lit(0.01).cast("decimal(18,2)"))
    again = dep.select("workspace_id", F.concat("deposit_id", F.lit("_again")).alias("deposit_id"), "deposit_date", (F.col("total_amount") + step).cast("decimal(18,2)").alias("total_amount"))
    return D.duplicates(dep.union(again), tolerance=0.02, mark="_again")


@query("select workspace_id, processor_payment_id, dense_rank() over (partition by workspace_id order by amount_gross desc) amount_rank from proc where event_type = 'payment' qualify row_number() over (partition by workspace_id order by amount_gross desc, k) <= 20")
def largest_payments(spark, d):
    p = V.processor_facts(spark, d).where("event_type = 'payment'")
    w = Window.partitionBy("workspace_id").orderBy(F.col("amount_gross").desc())
    first = p.withColumn("_n", F.row_number().over(w.orderBy(F.col("amount_gross").desc(), "k"))).where("_n <= 20")  # limited in each task before the shuffle
    return first.withColumn("amount_rank", F.dense_rank().over(w)).select("workspace_id", "processor_payment_id", "amount_rank")
