"""The match run against a plain loop, and score tables."""

import datetime
import random
import re
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillon.functions import labels
from quillon.functions import scores as S
from quillon.operators import allocation as B
from quillon.operators import matching as M
from quillon.operators import writes
from quillon.plans import matches
from quillon.sources.scratch import kept

DAY = datetime.date(2024, 5, 10)
PROC = "workspace_id string, processor_payment_id string, event_type string, payment_method string, amount_gross decimal(18,2), proc_date date, customer_email string, customer_name string"
ACCT = "k long, workspace_id string, accounting_id string, event_type string, ref_no string, amount_gross decimal(18,2), acct_date date, customer_email string, customer_name string"


def loop(proc, acct, deposited):
    """The run as a plain loop: three passes with pools of their own, newest first."""
    out = {}
    for name in ("card", "ach", "refund"):
        kind = "refund_observed" if name == "refund" else "payment_observed"
        mine = [p for p in proc if ("refund" if p[2] == "refund" else "ach" if p[3] == "bank_account" else "card") == name]
        theirs = [a for a in acct if a[3] == kind]
        index = {}
        for a in sorted(theirs, key=lambda a: (a[6], a[2]), reverse=True):
            if a[4]:
                index[a[1], a[4]] = a
        pool = [a for a in theirs if a[2] not in deposited]
        for p in sorted(mine, key=lambda p: (-p[5].toordinal(), p[1])):
            hit = index.get((p[0], p[1]))
            if hit:
                if hit[2] not in deposited:
                    out[p[1]] = (name, hit[2], 100, "deterministic")
                    pool = [a for a in pool if a[2] != hit[2]]
                continue
            if p[4] is None:
                out[p[1]] = (name, None, 0, "no_amount")
                continue
            free = [a for a in pool if a[1] == p[0] and abs(a[5]) == abs(p[4])]
            best = None
            for a in free:
                if a[4] and a[4] != p[1]:
                    continue
                d = (a[6] - p[5]).days
                dp = 25 if 0 <= d <= 3 else 12 if 4 <= d <= 7 else 10 if d == -1 else 5 if -7 <= d <= -2 else 0
                ip = 0
                na, nb = (p[7] or "").strip().lower(), (a[8] or "").strip().lower()
                if p[6] and a[7] and p[6].strip().lower() == a[7].strip().lower() or na and na == nb:
                    ip = 25
                elif na and nb:
                    ta, tb = sorted(na.replace(",", " ").split()), sorted(nb.replace(",", " ").split())
                    ip = 25 if ta == tb and len(ta) >= 2 else 12 if na in nb or nb in na else 0
                score = min(100, 40 + dp + ip + (10 if ip and len(free) == 1 else 0))
                key = (-score, -a[6].toordinal(), a[2])
                if best is None or key < best[0]:
                    best = (key, a[2], score, ip)
            if best is None:
                out[p[1]] = (name, None, 0, "no_match")
                continue
            ready = best[2] >= 80 and best[3] > 0
            if ready:
                pool = [a for a in pool if a[2] != best[1]]
            out[p[1]] = (name, best[1], best[2], "ready" if ready else "needs_review")
    return out


@pytest.mark.parametrize("seed, most", [(1, M.BLOCK_ROWS), (2, 0)])
def test_run_is_the_sequential_loop(spark, seed, most):
    """References across amounts, ties, several rows of one reference, deposits, three passes, few rows an amount."""
    r = random.Random(seed)
    names = ["Ann Lee", "Lee, Ann", "Bo Ek", None, "  ANN LEE ", "Ann", "Cy Orr"]
    mails = [None, "a@x.org", "A@X.org ", "b@x.org", ""]
    amounts = [Decimal(x) for x in r.sample(range(10, 400), 60)] + [None]
    proc = [(f"w{r.randint(0, 1)}", f"t{i:03}", r.choice(["payment", "payment", "refund"]), r.choice(["card", "bank_account", None]), r.choice(amounts), DAY + datetime.timedelta(r.randint(0, 12)), r.choice(mails), r.choice(names)) for i in range(220)]
    acct = []
    for i in range(240):
        p = r.choice(proc)
        other = r.choice(proc) if i % 3 == 0 else p
        ref, sign = r.choice([other[1], "", "", "", "zz", None]), r.choice([1, 1, -1])
        acct.append((i, p[0], f"q{i:03}", "refund_observed" if p[2] == "refund" else "payment_observed", ref, sign * (p[4] or Decimal(7)), p[5] + datetime.timedelta(r.randint(-8, 9)), r.choice(mails + [p[6]] * 3), r.choice(names + [p[7]] * 3)))
    deposited = {f"q{i:03}" for i in range(0, 240, 17)}
    got = M.run(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT), spark.createDataFrame([(x,) for x in deposited], "txn_id string"), most=most).collect()
    assert len(got) == len({g[0] for g in got})
    want = loop(proc, acct, deposited)
    assert {g[0]: tuple(g)[1:] for g in got} == want
    assert {w[3] for w in want.values()} == {"deterministic", "ready", "needs_review", "no_match", "no_amount"}


def test_hot_amounts_in_rounds(spark):
    """Two amounts hold nearly all rows, with more facts than rows at one of them, so that the last row of a pool is fought for."""
    r = random.Random(7)
    names = ["Ann Lee", "Lee, Ann", "Bo Ek", None, "Ann", "Cy Orr", "Bo", "Di"]
    mails = [None, "a@x.org", "b@x.org", "c@x.org", ""]
    amount = lambda: Decimal(r.choice([10, 10, 10, 20, 20, 30]))
    proc = [("w", f"t{i:03}", "payment", "card", amount(), DAY + datetime.timedelta(r.randint(0, 5)), r.choice(mails), r.choice(names)) for i in range(150)]
    acct = [(i, "w", f"q{i:03}", "payment_observed", r.choice(["", "", "", f"t{i:03}", "zz"]), amount(), DAY + datetime.timedelta(r.randint(-4, 9)), r.choice(mails), r.choice(names)) for i in range(90)]
    got = M.run(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT), most=0).collect()
    assert {g[0]: tuple(g)[1:] for g in got} == loop(proc, acct, set()) and len(got) == 150


def test_best_by_keys_is_the_best_of_all_pairs(spark):
    r = random.Random(3)
    names = ["Ann Lee", "Lee, Ann", "Bo Ek", None, "Ann", "An", "n", "Cy Orr of Malmo", "Orr of Malmo", " cy orr of malmo"]
    mails = [None, "a@x.org", "A@X.org", "b@x.org", ""]
    proc = [("w" + r.choice("12"), f"t{i:03}", "payment", "card", r.choice([Decimal(5), Decimal(-5), Decimal(7), None]), r.choice([None, DAY + datetime.timedelta(r.randint(0, 40))]), r.choice(mails), r.choice(names)) for i in range(120)]
    acct = [(i, "w" + r.choice("12"), f"q{i:03}", "payment_observed", r.choice(["", None, f"t{r.randrange(120):03}"]), r.choice([Decimal(5), Decimal(7), Decimal(-7), Decimal(9)]), r.choice([None, DAY + datetime.timedelta(r.randint(-9, 60))]), r.choice(mails), r.choice(names)) for i in range(60)]
    p, a = spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT)
    want = sorted(map(tuple, M.best(M.scored(M.candidates(p, a), "c")).collect()))
    assert sorted(map(tuple, M.best_by_keys(p, a).collect())) == want and len(want) > 50
    near = {x.processor_payment_id: x.n for x in M.candidates(p, a, signed=True).where(S.inside(F.col("days"), 7)).groupBy("processor_payment_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(x.n_near == near.get(x.processor_payment_id, 0) for x in M.near_counts(p, a).collect())


def _crowd(spark, seed, n_proc=120, n_acct=240):
    """Few amounts, days, mails and names, so that cells hold many rows, rows come from several kinds, and facts are copies of others."""
    r = random.Random(seed)
    names = ["Ann Lee", "Lee, Ann", "Bo Ek", None, "Ann", "An", "n", "Cy Orr of Malmo", "Orr of Malmo", " cy orr of malmo"]
    mails = [None, None, "a@x.org", "A@X.org", "b@x.org", ""]
    day = lambda lo, hi: r.choice([None, *[DAY + datetime.timedelta(r.randint(lo, hi))] * 7])
    proc = [("w" + r.choice("12"), f"t{i:03}", "payment", "card", r.choice([Decimal(5), Decimal(-5), Decimal(7), Decimal(8), None]), day(0, 14), r.choice(mails), r.choice(names)) for i in range(n_proc)]
    acct = [(i, "w" + r.choice("12"), f"q{i:03}", "payment_observed", r.choice(["", None, "", f"t{r.randrange(n_proc):03}", "t001"]), r.choice([Decimal(5), Decimal(7), Decimal(-7), Decimal(9)]), day(-9, 24), r.choice(mails), r.choice(names)) for i in range(n_acct)]
    return spark.createDataFrame(proc + [(*x[:1], f"u{x[1]}", *x[2:]) for x in proc[:40]], PROC), spark.createDataFrame([*acct, (999, "w1", "q999", "payment_observed", "", Decimal(8), DAY, None, "An")], ACCT)


@pytest.mark.parametrize("seed", [5, 6])
def test_top_by_keys_are_the_first_of_all_pairs(spark, seed):
    p, a = _crowd(spark, seed)
    want = M.top(M.scored(M.candidates(p, a), "c")).select("processor_payment_id", "rank", "accounting_id", "score").collect()
    assert sorted(map(tuple, M.top_by_keys(p, a).collect())) == sorted(map(tuple, want)) and len(want) > 400
    best = sorted(map(tuple, M.best(M.scored(M.candidates(p, a), "c")).collect()))
    assert sorted(map(tuple, M.best_by_keys(p, a).collect())) == best and any(b[-1] for b in best)


def test_engine_b_counts_the_week_before_there_are_pairs(spark):
    p, a = _crowd(spark, 8)
    pairs = M.candidates(p, a, signed=True, near=7)
    got = M.scored(pairs, "b")
    near = {}
    for x in M.candidates(p, a, signed=True).select("processor_payment_id", "days").collect():
        near[x[0]] = near.get(x[0], 0) + (x[1] is None or abs(x[1]) <= 7)
    rows = got.collect()
    assert len(rows) > 2000 and all(x.n_near == near[x.processor_payment_id] for x in rows) and 1 in near.values()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # from the top: no window, so no sort, over the pairs


def _block(spark, n=1500):
    """Facts and rows of one amount, and a pair of another, with some mails and names in common."""
    i, day = F.col("id"), F.date_add(F.lit(DAY), (F.col("id") % 400).cast("int"))
    mail = F.when(i % 5 > 0, F.concat(F.lit("a"), (i % 300).cast("string"), F.lit("@x.org")))
    side = spark.range(n).select(i.alias("k"), F.lit("w").alias("workspace_id"), F.when(i == 0, 9).otherwise(5).cast("decimal(18,2)").alias("amount_gross"), day.alias("day"), mail.alias("customer_email"), F.concat(F.lit("Ann "), (i % 200).cast("string")).alias("customer_name"))
    proc = side.select(F.format_string("t%05d", "k").alias("processor_payment_id"), F.lit("payment").alias("event_type"), F.lit("card").alias("payment_method"), F.col("day").alias("proc_date"), "*").select(*[c.split()[0] for c in PROC.split(", ")])
    acct = side.select("*", F.format_string("q%05d", "k").alias("accounting_id"), F.lit("payment_observed").alias("event_type"), F.when(F.col("k") % 3 == 0, F.format_string("t%05d", "k")).otherwise("").alias("ref_no"), F.col("day").alias("acct_date")).select(*[c.split()[0] for c in ACCT.split(", ")])
    return proc, acct


#: The queries of pairs: operator and columns of pairs.
PAIRS = {
    "amount_candidates": (lambda p, a: M.candidates(p, a, columns=["accounting_id"]), ["n_amount", "conflict"]),
    "name_identity_score": (lambda p, a: M.candidates(p, a, columns=["accounting_id", "_b"]).withColumn("points", S.points_of(F.col("_a"), F.col("_b"))), ["points"]),
    "score_engine_a": (lambda p, a: M.scored(M.candidates(p, a, signed=True, columns=["accounting_id", "_b"]), "a"), ["score", "level"]),
    "score_engine_c": (lambda p, a: M.scored(M.candidates(p, a, columns=["accounting_id", "_b"]), "c"), ["score", "level"]),
    "score_engine_b": (lambda p, a: M.scored(M.candidates(p, a, signed=True, near=7, columns=["accounting_id", "_b"]), "b"), ["identity", "score", "level"]),
}


@pytest.mark.parametrize("name", list(PAIRS))
def test_pairs_of_one_block_are_dealt_out_and_small_on_disk(spark, tmp_path, name):
    """A block of two million pairs is made by several tasks, and its files have few bits a pair."""
    made, columns = PAIRS[name]
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = made(*_block(spark)).select("processor_payment_id", "accounting_id", *columns)
        tasks = [x.n for x in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
        pairs.write.parquet(f"{tmp_path}/pairs")
        assert pairs.select("processor_payment_id", "accounting_id").distinct().count() == sum(tasks)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert sum(tasks) == 1499**2 + 1 or name == "score_engine_c"
    assert len(tasks) > 1 and max(tasks) < 0.5 * sum(tasks)
    assert size < 0.4 * sum(tasks) or name == "score_engine_c"  # names here hold each other often, so its scores are no runs


@pytest.mark.parametrize("chunk, parts", [(1, 1), (7, 40), (512, 256)])
def test_pairs_are_the_plain_join(spark, monkeypatch, chunk, parts):
    monkeypatch.setattr(M, "CHUNK", chunk)
    monkeypatch.setattr(M, "PARTS", parts)
    p, a = _crowd(spark, 9)
    want = sorted((x[1], y[2], x[5], y[6], y[4]) for x in p.collect() for y in a.collect() if x[0] == y[1] and x[4] is not None and abs(x[4]) == abs(y[5]))
    got = M.candidates(p, a).select("processor_payment_id", "accounting_id", "proc_date", "acct_date", "ref_no").collect()
    order = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert order(got) == order(want) and len(want) > 2000
    n = {}
    for x in want:
        n[x[0]] = n.get(x[0], 0) + 1
    assert all(x.n_amount == n[x.processor_payment_id] for x in M.candidates(p, a).select("processor_payment_id", "n_amount").distinct().collect())


@pytest.mark.parametrize("strategy", ["a", "b", "c"])
def test_pairs_are_handed_on_as_they_are_made(spark, strategy):
    """The join of chunks and packs is not in the stage that makes pairs, which would hold those of a chunk with a whole part."""
    p, a = _crowd(spark, 10)
    pairs = M.candidates(p, a, signed=strategy != "c", near=7 if strategy == "b" else None)
    df = M.scored(pairs, strategy).select("processor_payment_id", "accounting_id", "score")
    assert df.count() > 500 and df.collect()
    joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search(r"SortMergeJoin.* \[_part", x)]
    assert joins and not any("*(" in x for x in joins)


def test_likely_points_are_the_points(spark):
    """Marks only save looking at texts: names shorter than a piece, other letters, blanks and nulls too."""
    names = ["Ann Lee", "Lee, Ann", "lee  ann", "Ann", "An", "n", "nn", None, "", "  ", "Cy Orr of Malmö", "Orr of Malmö", "ö", "Malmö O", "aaa", "aaaa", "Customer#000000012 X", "Customer#000000012", "Customer#000000021"]
    one = spark.createDataFrame([(m, n) for m in (None, "", "a@x.org", "A@X.org") for n in names], "email string, name string")
    keys = S.identity_keys(F.col("email"), F.col("name"))
    side = lambda c: one.select(S.marks(keys, ("email", "name", "words")).alias(c))
    a, b = F.col("a"), F.col("b")
    got = side("a").crossJoin(side("b")).groupBy(S.likely_points(a, b).alias("likely"), S.points_of(a, b).alias("points")).count().collect()
    assert all(x.likely == x.points for x in got) and {x.points for x in got} == {0, 12, 25}


def test_pairs_have_only_what_is_asked_for(spark):
    """Fewer columns and keys, the same scores."""
    p, a = _crowd(spark, 11)
    for strategy, near in (("a", None), ("b", 7)):
        rows = lambda df: sorted(map(tuple, M.scored(df, strategy).select("processor_payment_id", "accounting_id", "score", "level").collect()))  # noqa: B023, E731
        few = M.candidates(p, a, signed=True, near=near, columns=["accounting_id", "_b"], own=["processor_payment_id", "_a"], keys=("email",))
        assert rows(few) == rows(M.candidates(p, a, signed=True, near=near)) and "name" not in few.select("_b.*").columns


def _decisions(proc, acct):
    """Engine A as a plain loop."""
    out = {}
    for p in proc:
        rated = []
        for a in acct:
            if a[1] == p[0] and a[5] == p[4] and p[4] is not None:
                d = abs((a[6] - p[5]).days) if a[6] and p[5] else 0
                same = (p[6] or "").strip() and (p[6] or "").strip().lower() == (a[7] or "").strip().lower()
                rated.append((40 + (25 if d <= 3 else 12 if d <= 7 else 0) + (20 if same else 0), a[2]))
        if not rated:
            out[p[1]] = (0, 0, False, "no_candidates", None)
            continue
        top_ = max(r[0] for r in rated)
        ids = sorted(r[1] for r in rated if r[0] == top_)
        score, tie = min(100, top_ + 25 * (len(rated) == 1)), len(ids) > 1
        matched = score >= 85 and not tie and p[0] != "w2"
        out[p[1]] = (len(rated), score, tie, "matched" if matched else "needs_review", ids[0] if matched else None)
    return out


def test_engine_a_is_the_loop_and_deals_days_once(spark):
    p, a = _crowd(spark, 8)
    r = random.Random(9)
    lone = [("w1", f"l{i}", "payment", "card", Decimal(100 + i), r.choice([None, DAY]), r.choice([None, "a@x.org"]), None) for i in range(30)]
    rows = [(1000 + i, "w1", f"r{i}", "payment_observed", "", Decimal(100 + i), r.choice([None, DAY, DAY + datetime.timedelta(6)]), r.choice([None, "A@x.org "]), None) for i in range(30)]
    p, a = p.union(spark.createDataFrame(lone, PROC)), a.union(spark.createDataFrame(rows, ACCT))
    want = _decisions(p.collect(), a.collect())
    got = {x.processor_payment_id: tuple(x)[2:] for x in M.decide_a(p, a, F.col("workspace_id") != "w2").collect()}
    assert got == want and {w[3] for w in want.values()} == {"no_candidates", "matched", "needs_review"}


def test_engine_a_meets_days_and_not_facts(spark, monkeypatch):
    """A thousand facts of one day look at the days about it once."""
    seen = []
    monkeypatch.setattr(M, "_days_about", lambda p, width=7, plain=M._days_about: seen.append(plain(p, width).count()) or plain(p, width))
    p = spark.range(1000).select(F.lit("w").alias("workspace_id"), F.concat(F.lit("t"), "id").alias("processor_payment_id"), F.lit(5).cast("decimal(18,2)").alias("amount_gross"), F.lit(DAY).alias("proc_date"), F.lit("a@x").alias("customer_email"))
    a = spark.createDataFrame([(1, "w", "q1", "payment_observed", "", Decimal(5), DAY, "a@x", None)], ACCT)
    assert M.decide_a(p, a, F.lit(True)).where("status = 'matched' and score = 100").count() == 1000 and seen == [15]


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_kept_is_not_broadcast_by_the_size_of_its_files(spark):
    """A table of few values has small files and many rows."""
    table = kept(spark.range(200_000).select("id", F.lit("a long name that all rows share, as files hold it once").alias("name")), "test")
    other = spark.range(10_000_000, numPartitions=4).withColumn("v", F.col("id") * 2)
    assert "BroadcastHashJoin" not in _nodes(other.join(table.where("id > 5"), "id")) and table.count() == 200_000


def test_what_is_kept_leaves_no_shuffle_files(spark):
    """They are many times the table's size, and else stay until the driver happens to collect its garbage."""
    held = lambda: {str(f.getName()) for f in map(files().apply, range(files().size())) if str(f.getName()).startswith("shuffle_")}
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    before = held()
    table = kept(spark.range(100_000, numPartitions=4).groupBy((F.col("id") % 5000).alias("g")).agg(F.max("id").alias("m")), "test")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and table.count() == 5000 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


@pytest.mark.parametrize("query", ["best_by_keys", "top_by_keys"])
def test_facts_are_dealt_once_after_the_rest_is_written(spark, query):
    """What is left to the result's own job is one join: facts, with the row that refers to them, and the best of what is found by identity and day."""
    p, a = _crowd(spark, 7)
    one = a.where("ref_no is null or ref_no = ''").union(a.where("ref_no <> ''").dropDuplicates(["ref_no"]))
    assert _nodes(getattr(M, query)(p, one)).count("Exchange hashpartitioning") <= 2


def test_sections_join_what_is_written(spark):
    """Two joins of facts with written tables; the searches' shuffles would stay on disk beside them."""
    assert 1 <= _nodes(M.sections(*_crowd(spark, 9))).count("Exchange hashpartitioning") <= 4


def test_facts_that_are_there_twice_count_twice(spark):
    p, a = _crowd(spark, 8)
    other = p.where("processor_payment_id < 't020'").withColumn("proc_date", F.date_add("proc_date", 3))
    p = p.union(p.where("processor_payment_id < 't040'")).union(other)
    assert sorted(map(str, M.best_by_keys(p, a).collect())) == sorted(map(str, M.best(M.scored(M.candidates(p, a), "c")).collect()))


@pytest.mark.parametrize("query", ["best_by_keys", "top_by_keys"])
def test_copies_of_facts_and_rows_meet_once(spark, query, monkeypatch):
    """Sixty copies of a fact and of its row are one cell each (five rows, where five are asked for), and not their product."""
    met = []
    monkeypatch.setattr(M, "identity_pairs", lambda p, a, block, plain=M.identity_pairs: met.append(plain(p, a, block).count()) or plain(p, a, block))
    proc = [("w", f"t{i:03}", "payment", "card", Decimal(5), DAY, "a@x.org", "Ann Lee") for i in range(60)]
    acct = [(i, "w", f"q{i:03}", "payment_observed", "", Decimal(5), DAY, "a@x.org", "Ann Lee") for i in range(60)]
    got = getattr(M, query)(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT))
    assert got.count() == (60 if query == "best_by_keys" else 300) and met[0] <= 5


@pytest.mark.parametrize("most", [0, 100_000])
def test_copies_meet_once_in_the_run(spark, monkeypatch, most):
    """Sixty copies of a fact and forty of its row, of two days, are decided as the loop does, but found as kinds and not one by one."""
    met = []
    monkeypatch.setattr(M, "identity_pairs", lambda p, a, block, plain=M.identity_pairs: met.append(plain(p, a, block).count()) or plain(p, a, block))
    proc = [("w", f"t{i:03}", "payment", "card", Decimal(5), DAY + datetime.timedelta(i % 2), "a@x.org", "Ann Lee") for i in range(60)]
    acct = [(i, "w", f"q{i:03}", "payment_observed", "", Decimal(5), DAY + datetime.timedelta(i % 2), "a@x.org", "Ann Lee") for i in range(40)]
    got = {g[0]: tuple(g)[1:] for g in M.run(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT), most=most).collect()}
    assert got == loop(proc, acct, set()) and met[0] <= 4


def test_a_reference_to_another_amount_empties_that_pool(spark):
    proc = [("w", "t1", "payment", "card", Decimal(10), DAY, None, "Ann"), ("w", "t2", "payment", "card", Decimal(20), DAY, None, "Ann")]
    acct = [(1, "w", "q1", "payment_observed", "t1", Decimal(20), DAY, None, "Ann"), (2, "w", "q2", "payment_observed", "", Decimal(20), DAY, None, "An")]
    got = {g[0]: tuple(g)[2:] for g in M.run(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT)).collect()}
    assert got == {"t1": ("q1", 100, "deterministic"), "t2": ("q2", 87, "ready")}  # q2 is alone once q1 is gone


def test_the_run_reads_its_sides_as_written_tables(spark):
    sides = matches._run(spark, "/root/testdata/sf0.001", lambda p, a, gone, explained: p.select("processor_payment_id").union(a.select("accounting_id")).union(gone).union(explained))
    assert not any("customer" in f or "orders" in f for f in sides.inputFiles())  # each read of a view joined orders to customers, which may be broadcast each time


def loop_b(proc, acct):
    """Engine B as a plain loop over all free rows of equal signed amount."""
    out, gone = {}, set()
    index = {}
    for a in sorted(acct, key=lambda a: (a[6], a[2]), reverse=True):
        if a[4]:
            index[a[1], a[4]] = a[2]
    for p in proc:
        if (p[0], p[1]) in index:
            out[p[1]] = (index[p[0], p[1]], 100, "high", False)
            gone.add(index[p[0], p[1]])
    for p in sorted(proc, key=lambda p: (-p[5].toordinal() if p[5] else 1 << 30, p[1])):
        if p[1] in out:
            continue
        free = [a for a in acct if a[2] not in gone and a[1] == p[0] and a[5] == p[4]]
        inside = [a for a in free if not p[5] or not a[6] or abs((a[6] - p[5]).days) <= 7]
        rated = []
        for a in free:
            d = (a[6] - p[5]).days if a[6] and p[5] else 99
            same = bool(p[6] and a[7] and p[6].strip() and p[6].strip().lower() == a[7].strip().lower())
            rated.append((-(40 + (25 if 0 <= d <= 3 else 12 if 4 <= d <= 7 else 10 if d == -1 else 5 if -7 <= d <= -2 else 0) + (10 + 10 * (len(inside) == 1) if same else 0)), a[2], same))
        rated.sort()
        if not rated:
            out[p[1]] = (None, 0, "none", False)
            continue
        score, tie = -rated[0][0], len(rated) > 1 and rated[1][0] == rated[0][0]
        identity = any(r[2] for r in rated if r[0] == rated[0][0])
        if not tie:
            gone.add(rated[0][1])
        out[p[1]] = (rated[0][1], score, "high" if score >= 80 and identity else "medium" if score >= 50 else "low", tie)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_engine_b_is_the_sequential_loop(spark, seed):
    r = random.Random(seed)
    mails = [None, "a@x.org", "A@X.org ", "b@x.org", "c@x.org", "", " "]
    amounts = [Decimal(x) for x in r.sample(range(-50, 400), 25)]
    day = lambda lo, hi: r.choice([None, *[DAY + datetime.timedelta(r.randint(lo, hi))] * 9])
    proc = [(f"w{r.randint(0, 1)}", f"t{i:03}", "payment", "card", r.choice(amounts), day(0, 20), r.choice(mails), None) for i in range(250)]
    acct = [(i, f"w{r.randint(0, 1)}", f"q{i:03}", "payment_observed", r.choice(["", "", "", None, f"t{r.randrange(300):03}"]), r.choice(amounts), DAY + datetime.timedelta(r.randint(-9, 30)), r.choice(mails), None) for i in range(260)]
    got = {g.processor_payment_id: (g.accounting_id, g.score, g.level, g.has_tie) for g in B.run(spark.createDataFrame(proc, PROC), spark.createDataFrame(acct, ACCT)).collect()}
    want = loop_b(proc, acct)
    assert got == want and {w[2] for w in want.values()} == {"high", "medium", "low", "none"} and any(w[3] for w in want.values())
    taken = [g[0] for g in got.values() if g[0] and not g[3]]
    assert len(taken) == len(set(taken))


def test_date_points(spark):
    rows = {d: p for d, p in spark.createDataFrame([(d,) for d in (-8, -7, -2, -1, 0, 3, 4, 7, 8)], "d int").select("d", S.date_points(F.col("d"))).collect()}
    assert rows == {-8: 0, -7: 5, -2: 5, -1: 10, 0: 25, 3: 25, 4: 12, 7: 12, 8: 0}


def test_identity_points(spark):
    cases = [("a@x", "A@X ", None, None, 25), (None, None, "Lee, Ann", "ann lee", 25), (None, None, "Ann Lee", "Ann", 12), ("", "", "", "", 0), (None, None, None, "x", 0), ("a@x", "b@x", "Bo", "Al", 0)]
    got = spark.createDataFrame([c[:4] for c in cases], "a string, b string, c string, d string").select(S.identity_points(*map(F.col, "abcd"))).collect()
    assert [g[0] for g in got] == [c[4] for c in cases]


def test_fee_and_lag_points(spark):
    got = spark.createDataFrame([(f,) for f in (-1.0, 0.0, 10.0, 10.5, 25.0, 50.0, 100.0, 120.0, 500.0)], "f double").select(S.fee_points(F.col("f"))).collect()
    assert [g[0] for g in got] == [0, 100, 100, 90, 90, 75, 60, 30, 0]
    got = spark.createDataFrame([(d,) for d in (-1, 0, 1, 3, 5, 10, 14, 20, 21)], "d int").select(S.lag_points(F.col("d"))).collect()
    assert [g[0] for g in got] == [0, 20, 50, 80, 100, 100, 80, 50, 20]


def test_version_key(spark):
    got = spark.createDataFrame([("1.2.3",), ("2",), ("1.10b",), ("",)], "v string").select(labels.version_key(F.col("v"))).collect()
    assert [g[0] for g in got] == [[1, 2, 3], [2, 0, 0], [1, 10, 0], [0, 0, 0]]


def test_writes(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    old = spark.createDataFrame([(2, "z")], "id int, v string")
    assert [r["id"] for r in writes.appended(new, old, ["id"]).collect()] == [1]
    log = spark.createDataFrame([("k", 1, "x"), ("k", 3, "y"), ("k", 2, "z")], "k string, t int, v string")
    assert writes.latest(log, ["k"], "t", ["v"]).first()["v"] == "y"
    assert writes.first_wins(log, ["k"], "t", ["v"]).first()["v"] == "x"
