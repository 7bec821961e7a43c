"""Ingestion of captured objects as a stream: deduplicated, with a cursor, late rows merged in."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over the Parquet files of a folder, a bounded number of files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)


def merge_into(path: str, keys: list[str], time: str | None = None):
    """For foreachBatch: appends what isn't in the table yet, so reading a boundary twice, or a row that comes late by any time, changes nothing and loses nothing.

    With `time`, the table has a partition for each day of it, and a batch is held against the days that it has
    rows of, not against the whole table; a key must then keep its time.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark, new = rows.sparkSession, rows.dropDuplicates(keys)
        if time:
            new = new.withColumn("day", F.to_date(time))
        if _exists(spark, path):
            there = spark.read.parquet(path)
            if time:
                days = [r["day"] for r in new.select("day").distinct().collect()]  # at most one for each day that the batch spans
                there = there.where(F.col("day").isin(days) | F.col("day").isNull())
            new = new.join(there.select(*keys), keys, "left_anti")
        writer = new.write.mode("append")
        (writer.partitionBy("day") if time else writer).parquet(path)

    return batch


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).schema)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # not there, or nothing in it yet
            return False
        raise


def drained(stream: DataFrame, sink, folder: str) -> None:
    """Runs what is there now, and ends."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def cursor(rows: DataFrame, by: list[str], time: str) -> DataFrame:
    """The high-water mark of each source."""
    return rows.groupBy(*by).agg(F.max(time).alias("cursor"), F.count(F.lit(1)).alias("n"))
