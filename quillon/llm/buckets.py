"""Packing into length buckets of least padding, with batches of a token budget inside each.

The lengths of all documents make a histogram, of as many rows as there are lengths. Dynamic programming
over it chooses the bucket bounds that minimise padding: with the lengths in order, the least padding of the
first j in k buckets is the least over i of that of the first i in k - 1 buckets plus that of lengths i..j
padded to length j. The best i never falls as j grows, so each layer is solved by divide and conquer. Inside
a bucket rows are ranked without gaps (ranges, not one task) and cut into batches of budget // bound rows.

Defined results: a null or empty text has length 0 and goes with the shortest bucket; a text longer than
the budget makes a batch of its own row, uncut; equal lengths are ordered by a hash, then doc_id (null first); repeated
rows each take a place; an empty table gives an empty result; other columns are ignored. The driver holds a row for
each distinct length: with D of them some 32 * D bytes and D * log D steps a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import Words, ranked, slices, written

BUCKETS, BUDGET = 16, 16_384


def _lengths(batches):
    for batch in batches:
        for a, b, data, bounds in slices(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(Words(data, bounds).first), pa.int64())], names=["doc_id", "mix", "length"])


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> tuple[list[int], int]:
    """Of ascending distinct lengths and their counts: the bounds of at most `buckets` buckets with the least padding, and that padding."""
    d = len(lengths)
    if d == 0:
        return [], 0
    at = np.asarray(lengths, dtype=np.float64)
    rows = np.concatenate([[0], np.cumsum(np.asarray(counts, dtype=np.float64))])
    tokens = np.concatenate([[0], np.cumsum(at * counts)])
    least = at * rows[1:] - tokens[1:]  # one bucket for the first j + 1 lengths
    choice = [np.zeros(d, dtype=np.int64)]
    for _ in range(1, min(buckets, d)):
        best, cut = np.empty(d), np.zeros(d, dtype=np.int64)
        todo = [(0, d - 1, 0, d - 1)]
        before = np.concatenate([[0.0], least])  # of the first i lengths
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j, last) + 1)
            cost = before[i] + at[j] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i])
            k = int(np.argmin(cost))
            best[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, first, int(i[k])), (j + 1, hi, int(i[k]), last)]
        least = best
        choice.append(cut)
    bounds, j = [], d - 1
    for cut in reversed(choice):
        if j < 0:
            break
        bounds.append(int(lengths[j]))
        j = int(cut[j]) - 1
    return bounds[::-1], int(round(least[-1]))


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, length (words), bucket, padded (its bound), batch (gapless from 0 over all buckets), place (in the batch)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("mix"), "text")
    lengths = written(rows.mapInArrow(_lengths, "doc_id long, mix long, length long"), "lengths")
    histogram = sorted((r["length"], r["n"]) for r in lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect())
    bounds, _ = bucket_bounds([x for x, _ in histogram], [n for _, n in histogram], buckets)
    per_batch = [max(1, budget // max(1, b)) for b in bounds]
    held = [0] * len(bounds)
    for length, n in histogram:
        held[int(np.searchsorted(bounds, length))] += n
    first = np.concatenate([[0], np.cumsum([-(-n // p) for n, p in zip(held, per_batch)])]).tolist()
    bucket = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values or [1]]), F.col("bucket") + 1)
    # Repeated rows share hash and doc_id; a number of their own makes the order total.
    placed = ranked(lengths.withColumn("bucket", bucket).withColumn("tie", F.monotonically_increasing_id()), ["bucket"], ["length", "mix", "doc_id", "tie"], "turn")
    return placed.select("doc_id", "length", "bucket", of(bounds).alias("padded"), (of(first) + F.floor(F.col("turn") / of(per_batch))).alias("batch"), (F.col("turn") % of(per_batch)).alias("place"))
