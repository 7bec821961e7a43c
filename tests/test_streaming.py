"""Streams lose nothing, whatever the order of files."""

import datetime

from quillon.streaming import ingest as I


def test_late_rows_are_kept(spark, tmp_path):
    start = datetime.datetime(2024, 3, 1)
    made = [(i, start + datetime.timedelta(days=d)) for i, d in enumerate([20, 10, 0, 20, 9, 1])]
    schema = "event_id long, ts timestamp"
    for n, row in enumerate(made + made[:3]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "table")
    I.drained(stream, I.merge_into(path, ["event_id"], "ts"), str(tmp_path))
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4, 5]


def test_table_that_is_not_there(spark, tmp_path):
    assert not I._exists(spark, str(tmp_path / "none"))
