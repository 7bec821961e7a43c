"""Paging sources: read to the last page, filters taken over, restart without loss, broken chains refused."""

import datetime
import json
import shutil

import pytest
from pyspark.sql import functions as F

from quillon.sources import paged as P
from quillon.streaming import ingest as I

DAY = datetime.date(2024, 1, 1)
ROWS = "object string, source string, id string, updated date, body string, page int"


def made(n):
    return [(kind, source, f"{kind}{i:05}", DAY + datetime.timedelta(i // 10), json.dumps({"n": i}), i // 7) for kind in ("charge", "refund") for source in ("acct_1", "acct_2") for i in range(n) if kind == "charge" or i % 3 == 0]


@pytest.mark.parametrize("cursor", [True, False])
def test_batch_reads_every_page(spark, tmp_path, cursor):
    P.register(spark)
    path, rows = str(tmp_path / "pages"), made(1200)
    P.write_pages(spark.createDataFrame(rows, ROWS), path, "page", cursor)
    df = spark.read.format("recorded_pages").load(path)
    assert sorted(map(tuple, df.collect())) == sorted(r[:5] for r in rows)
    since = DAY + datetime.timedelta(100)
    some = df.where((F.col("updated") >= F.lit(since)) & (F.col("object") == "charge") & F.col("body").isNotNull())
    assert sorted(map(tuple, some.collect())) == sorted(r[:5] for r in rows if r[0] == "charge" and r[3] >= since)
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip().startswith(("Filter", "*(1) Filter", "+- Filter", "+- *(1) Filter"))]
    assert not any("updated" in line and ">=" in line or "= charge" in line for line in filters), plan


def test_pages_are_skipped_by_their_names(spark, tmp_path):
    P.register(spark)
    path = str(tmp_path / "pages")
    P.write_pages(spark.createDataFrame(made(700), ROWS), path, "page")
    reader = P.Pages(path)
    assert list(reader.pushFilters([P.GreaterThanOrEqual(("updated",), DAY + datetime.timedelta(60)), P.EqualTo(("object",), "charge")])) == []
    runs = reader.partitions()
    assert {r.chain for r in runs} == {("charge", "acct_1"), ("charge", "acct_2")}
    assert sum(len(r.folders) for r in runs) == 2 * 15  # of a hundred pages a chain, those with a row from id 600 on
    assert sum(1 for r in runs for _ in reader.read(r)) == 2 * 100


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    P.register(spark)
    path, folder = str(tmp_path / "pages"), str(tmp_path)
    for n in (350, 350, 700):
        shutil.rmtree(path, ignore_errors=True)  # recorded anew, at last as longer chains
        P.write_pages(spark.createDataFrame(made(n), ROWS), path, "page")
        stream = spark.readStream.format("recorded_pages").load(path)
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start().awaitTermination()
        got = sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect()))
        assert got == sorted(r[:5] for r in made(n))


def test_a_gap_is_an_error(spark, tmp_path):
    P.register(spark)
    path = tmp_path / "pages"
    P.write_pages(spark.createDataFrame(made(100), ROWS), str(path), "page")
    chain = path / "object=charge" / "source=acct_1"
    shutil.rmtree(sorted(chain.iterdir())[3])
    with pytest.raises(Exception, match="doesn't follow"):
        spark.read.format("recorded_pages").load(str(path)).collect()
    for page in sorted(chain.iterdir())[3:]:
        shutil.rmtree(page)
    with pytest.raises(Exception, match="break off"):
        spark.read.format("recorded_pages").load(str(path)).collect()
    assert spark.read.format("recorded_pages").load(str(path)).where("source = 'acct_2'").count() == 134
    assert spark.read.format("recorded_pages").load(str(tmp_path / "none")).count() == 0
