"""Values of the row before, and digests, over keys that may hold most rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.sources.scratch import kept


def lagged(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, ranges: int | None = None) -> DataFrame:
    """rows with `out`: the value of the row before within keys, in the order of `order`, which must be unique within keys; null for a key's first row.

    Rows are dealt by range of keys and order, so a key of many rows spans ranges. Within a range the row before
    comes from a window; what goes over a boundary is the last row of the range before, of which there is one for each range and key.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept(rows.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()), "dealt")
    last = F.max(F.struct(*order, F.col(value).alias("_v")))
    edges = dealt.groupBy("_part", *keys).agg(last.alias("_last"))
    edges = edges.withColumn("_over", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")))  # a row for each range that a key spans
    before = F.struct(*order, F.col(value).alias("_v"))
    inside = dealt.withColumn("_in", F.lag(before).over(Window.partitionBy("_part", *keys).orderBy(*order)))
    joined = inside.join(edges.select("_part", *keys, "_over"), ["_part", *keys])
    return joined.withColumn(out, F.when(F.col("_in").isNotNull(), F.col("_in._v")).otherwise(F.col("_over._v"))).drop("_part", "_in", "_over")


def _running_hash(batches):
    """From (key, id) sorted by both: key, ids and the SHA-256 of their JSON list, one key open at a time."""
    key, n, digest, done = None, 0, None, []

    def closed():
        digest.update(b"]")
        return key, n, digest.hexdigest()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if digest is None or keys[a] != key:
                if digest is not None:
                    done.append(closed())
                key, n, digest = keys[a], 0, hashlib.sha256(b"[")
            text = '", "'.join(ids[a:b])
            digest.update(((', "' if n else '"') + text + '"').encode())
            n += b - a
        if len(done) >= 1000:
            yield _hashes(done)
            done = []
    if digest is not None:
        done.append(closed())
    if done:
        yield _hashes(done)


def _hashes(done: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["key", "n", "hash"])


def ids_hashes(rows: DataFrame, key: str, id_: Column) -> DataFrame:
    """key, n, hash: for each key the SHA-256 of the JSON list of its ids in order, as `ids.ids_hash` gives it, without a list of them: ids are sorted
    by Spark, which spills, and go through a running hash. A key without a value has no row; ids need no escapes in JSON."""
    sorted_ = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), id_.cast("string").alias("id")).where("id is not null").repartition("key").sortWithinPartitions("key", "id")
    return sorted_.mapInArrow(_running_hash, "key string, n long, hash string")


