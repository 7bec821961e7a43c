"""Runs committed as one, values over ranges, running hashes, late refunds, observed counters."""

import hashlib
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.operators import commits as C
from quillon.operators import observed as O
from quillon.operators import ranges as R
from quillon.streaming import healing as H
from quillon.streaming import ingest as I


def test_a_run_that_fails_between_two_tables_shows_nothing(spark, tmp_path):
    folder = str(tmp_path)
    batches, outcomes, reviews = (spark.range(n) for n in (3, 5, 2))
    schema = batches.schema
    counts = lambda: [C.visible(spark, folder, name, schema).count() for name in ("batches", "outcomes", "reviews")]

    def fails():
        raise RuntimeError("lost")

    assert counts() == [0, 0, 0]
    with pytest.raises(RuntimeError):
        C.commit(spark, folder, "r1", {"batches": batches, "outcomes": outcomes, "reviews": fails})
    assert counts() == [0, 0, 0] and not C.committed(spark, folder, "r1")
    assert len(C.abandoned(spark, folder, ["batches", "outcomes", "reviews"])) == 2
    tables = {"batches": batches, "outcomes": outcomes, "reviews": reviews}
    assert C.commit(spark, folder, "r1", tables) and counts() == [3, 5, 2]
    assert not C.commit(spark, folder, "r1", tables) and counts() == [3, 5, 2]
    assert C.commit(spark, folder, "r2", {"batches": batches, "outcomes": outcomes}) and counts() == [6, 10, 2]
    assert len(C.abandoned(spark, folder, ["batches", "outcomes", "reviews"])) == 2


@pytest.mark.parametrize("ranges", [1, 7])
def test_lag_over_ranges(spark, ranges):
    r = random.Random(ranges)
    rows = [("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(50), i, r.choice(["x", "y", None])) for i in range(600)] + [("once", 1, 999, "z"), (None, 1, 1000, "n"), (None, 2, 1001, "m")]
    df = spark.createDataFrame(rows, "k string, t int, id int, v string")
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("t", "id"))).where("k is not null")
    got = R.lagged(df.where("k is not null"), ["k"], ["t", "id"], "v", "p", ranges)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    dealt = df.repartitionByRange(7, "k", "t", "id").groupBy(F.spark_partition_id()).count()
    assert max(x["count"] for x in dealt.collect()) < 300  # the hot key's 400 rows are in several ranges


def test_hash_of_many_ids_in_small_batches(spark):
    rows = [(f"w{i % 3}", f"id{i:05}") for i in range(3000)] + [("one", "x"), (None, "y"), ("w0", None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {x.key: (x.n, x.hash) for x in R.ids_hashes(spark.createDataFrame(rows, "w string, id string"), "w", F.col("id")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for w in ("w0", "w1", "w2", "one"):
        ids = sorted(i for k, i in rows if k == w and i)
        assert got[w] == (len(ids), hashlib.sha256(json.dumps(ids).encode()).hexdigest())
    assert len(got) == 4


def test_refunds_outside_the_window_arrive_once(spark, tmp_path):
    folder = str(tmp_path)
    store = spark.createDataFrame([(f"q{i}", i) for i in range(20)], "accounting_id string, amount int")
    line = lambda kind, i: (kind, f"q{i}")
    deposits = [("d1", [line("RefundReceipt", 1), line("Payment", 2)]), ("d2", [line("RefundReceipt", 1), line("RefundReceipt", 15)]), ("d3", [line("RefundReceipt", 99)]), ("d4", [])]
    schema = "deposit_id string, lines array<struct<txn_type:string,txn_id:string>>"
    for wave in (deposits[:2], deposits, deposits):
        spark.createDataFrame(wave, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        I.drained(spark.readStream.schema(schema).parquet(f"{folder}/in"), H.heal_from(lambda: store, f"{folder}/refunds"), folder)
        assert sorted(r.accounting_id for r in spark.read.parquet(f"{folder}/refunds").collect()) == ["q1", "q15"]
    H.heal_from(lambda: store, f"{folder}/refunds")(spark.createDataFrame(deposits, schema), 0)  # a batch that is tried again
    assert spark.read.parquet(f"{folder}/refunds").count() == 2


def test_counters_are_observed_once(spark, tmp_path):
    df = spark.range(1000).withColumn("odd", F.col("id") % 2)
    assert O.write_counted(df, str(tmp_path / "t"), {"n": F.count(F.lit(1)), "odd": F.sum("odd")}) == {"n": 1000, "odd": 500}
    for i in range(3):
        spark.range(10 * (i + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = O.Counted("c")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("c", F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert O.totals(query, "c") == {"n": 60, "s": sum(n * (n - 1) // 2 for n in (10, 20, 30))} == listener.totals and len(listener.batches) >= 3
