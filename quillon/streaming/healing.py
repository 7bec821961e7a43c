"""Late data: refunds that deposits name but the sync window left out are read from the raw store in the batch that names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.streaming.ingest import _exists


def heal_from(raw: Callable[[], DataFrame], path: str, key: str = "accounting_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over deposits(deposit_id, lines array<struct<txn_type, txn_id, ..>>): appends to the refunds at `path` those that the batch names and the table lacks, from the raw store.

    Batches name few of the refunds there are, so their ids come first: they are held against the table and what is left of
    them against the raw store. A replayed batch finds all of its refunds in the table and adds none; a refund that the raw
    store lacks, too, is looked for again when a later deposit names it.
    """

    def batch(deposits: DataFrame, _: int) -> None:
        spark = deposits.sparkSession
        named = deposits.select(F.explode("lines").alias("l")).where("l.txn_type = 'RefundReceipt'").select(F.col("l.txn_id").alias(key)).distinct()
        if _exists(spark, path):
            named = named.join(spark.read.parquet(path).select(key), key, "left_anti")
        raw().join(named, key, "left_semi").dropDuplicates([key]).write.mode("append").parquet(path)

    return batch
