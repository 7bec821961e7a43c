"""Embedding near-deduplication with a pivot-permutation index.

Reference points (pivots) are taken from the data. A vector is described by its nearest pivots in order,
by cosine, and posted in inverted lists. Vectors of one label that share `shared` of their `nearest` pivots are
candidates; a pair is looked at in the list of the first pivots that it shares and nowhere else, so each link counts
once. Candidates are verified by their cosine in double precision.

A list belongs to one pivot, or, as the pivots are a bounded sample and their lists would grow with the table, to
two or three pivots together (`arity`): the same pairs are candidates, from thousands or millions of times as many
lists. Equal vectors of a label form a class and are indexed once, with a weight. A list is cut into blocks, and
each pair of blocks is a group of bounded size; it gives back a row per vector (links counted, and the least
class it hangs together with there), never the pairs. Every vector is indexed.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one with a
null label, links with nothing; vectors of unequal length never link; repeated rows are copies of each
other and each gives a row; vectors that share a vec_id are judged each for itself; a row with a null vec_id counts
as a link of others and may join them, but names no component (one of such rows alone has a null component_id); ties
go to the smallest vec_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.shared import dropped, written

NEAREST, SHARED, BLOCK, MOST_PIVOTS = 8, 3, 1000, 2048
#: Mean rows of a list beyond which its key takes one more pivot.
LONG_LIST = 5_000


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of lists as a matrix of doubles, with zeros up to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def pivot_count(n: int) -> int:
    """The pivots for n vectors: about one for 200 vectors, so that lists stay alike, within 64 and MOST_PIVOTS."""
    return min(MOST_PIVOTS, max(64, 1 << max(0, math.ceil(math.log2(max(1, n) / 200)))))


def arity(n: int, pivots: int, nearest: int, shared: int) -> int:
    """The pivots in the key of a list, for n vectors: no more than candidates share, and so few that lists stay short."""
    for t in range(1, shared):
        if n * math.comb(nearest, t) / math.comb(pivots, t) <= LONG_LIST:
            return t
    return shared


def _describe(pivots: np.ndarray, nearest: int):
    def scan(batches):
        for batch in batches:
            width = max(pivots.shape[1], int(pa.compute.max(pa.compute.list_value_length(batch.column(2))).as_py() or 0) if len(batch) else 0)
            x = _matrix(batch.column(2), width)[:, : pivots.shape[1]]
            order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :nearest].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * order.shape[1], pa.int32()), pa.array(order.ravel()))], names=["cls", "label", "vec", "weight", "near"])

    return scan


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _verify(shared: int, least: float, n_pivots: int):
    """Of a pair of blocks: for each class with links there, their weight and the least class of its component."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def links(key, table):
        pivots, first, second = (key[i].as_py() for i in (2, 3, 4))
        table = table.sort_by("cls")
        block = np.asarray(table["block"])
        cls, weight = np.asarray(table["cls"]), np.asarray(table["weight"])
        x = _matrix(table["vec"], key[1].as_py())
        x_len = np.sqrt((x * x).sum(axis=1))
        near = np.asarray(table["near"].combine_chunks().flatten()).reshape(len(cls), -1)
        marks = np.zeros((len(cls), n_pivots), dtype=np.float32)
        np.put_along_axis(marks, near, 1, axis=1)
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        both = marks[a] @ marks[b].T
        before = marks[a][:, : pivots[-1]] @ marks[b][:, : pivots[-1]].T  # pivots shared before this list's last
        i, j = np.nonzero((both >= shared) & (before == len(pivots) - 1))
        i, j = a[i], b[j]
        keep = i < j if first == second else np.ones(len(i), dtype=bool)
        i, j = i[keep], j[keep]
        hit = np.zeros(len(i), dtype=bool)
        for s in range(0, len(i), 100_000):
            p, q = i[s : s + 100_000], j[s : s + 100_000]
            hit[s : s + 100_000] = np.einsum("ij,ij->i", x[p], x[q]) / (x_len[p] * x_len[q]) >= least
        i, j = i[hit], j[hit]
        n = np.bincount(i, weights=weight[j], minlength=len(cls)) + np.bincount(j, weights=weight[i], minlength=len(cls))
        some = np.flatnonzero(n > 0)
        return pa.Table.from_arrays([pa.array(cls[some]), pa.array(n[some].astype(np.int64)), pa.array(cls[_roots(len(cls), i, j)[some]])], schema=schema)

    return links


def near_duplicates(vectors: DataFrame, least: float = 0.98, nearest: int = NEAREST, shared: int = SHARED, keys: int | None = None) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept (vec_id is component_id). `keys` is the arity of the lists, by default chosen by their length; it doesn't change the result."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding", valid.alias("ok"))
    keyed = rows.withColumn("k", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")), 256)))
    classes = keyed.where("ok").groupBy("k").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # written, so the numbers stay
    n = classes.count()
    pivots = classes.orderBy(F.xxhash64("k"), "k").limit(pivot_count(n)).select("vec").collect()
    width = max((len(r["vec"]) for r in pivots), default=1)
    points = np.zeros((len(pivots), width))
    for i, r in enumerate(pivots):
        points[i, : len(r["vec"])] = r["vec"]
    points /= np.maximum(np.sqrt((points**2).sum(axis=1, keepdims=True)), 1e-300)
    nearest = min(nearest, max(1, len(pivots)))
    label, vec = dict(classes.dtypes)["label"], dict(classes.dtypes)["vec"]
    described = written(classes.select("cls", "label", "vec", "weight").mapInArrow(_describe(points, nearest), f"cls long, label {label}, vec {vec}, weight long, near array<int>"), "described").withColumn("dim", F.size("vec"))
    of_key = list(itertools.combinations(range(nearest), keys or arity(n, len(pivots), nearest, min(shared, nearest))))
    posted = described.withColumn("_s", F.array_sort("near")).withColumn("key", F.explode(F.array(*[F.array(*[F.col("_s")[i] for i in c]) for c in of_key]))).drop("_s")
    lists = posted.groupBy("label", "dim", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"), F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c")
    dealt = posted.join(lists, ["label", "dim", "key"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dim", "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "cls", "vec", "weight", "near")
    found = written(dealt.groupBy("label", "dim", "key", "first", "second").applyInArrow(_verify(min(shared, nearest), least, len(pivots)), "cls long, links long, root long"), "found")
    dropped(described)
    joined = written(components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))), "joined")
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    small = classes.select("k", "rep", "cls", "weight")
    together = small.join(joined, small.cls == joined.node).groupBy("component").agg(F.min("rep").alias("_least"))
    per_class = small.join(totals, "cls", "left").join(joined.join(together, "component").withColumnRenamed("node", "cls"), "cls", "left")
    named = per_class.select(F.col("k").alias("_k"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_n"), F.coalesce("_least", "rep").alias("_c"))
    named = written(named, "named")  # a table of its own, so that a hot class is split in the join
    for table in (classes, found, joined):
        dropped(table)
    out = keyed.select("vec_id", "k").join(named, F.col("k") == F.col("_k"), "left")
    component = F.when(F.col("k").isNotNull(), F.col("_c")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def sql(least: float = 0.98) -> str:
    """The same for DuckDB over the view embeddings, with all pairs of a label."""
    return f"""
with recursive v as materialized (select vec_id, label, embedding::double[] e from embeddings),
g as materialized (select vec_id, label, e, sqrt(list_dot_product(e, e)) l from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
p as materialized (select a.vec_id a, b.vec_id b from g a join g b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / (a.l * b.l) >= {least}),
reach(vec_id, r) as (select vec_id, vec_id from v union select p.b, reach.r from reach join p on p.a = reach.vec_id),
c as (select vec_id, min(r) component_id from reach group by vec_id),
n as (select a vec_id, count(*) n from p group by a)
select c.vec_id, coalesce(n.n, 0) n_links, component_id, c.vec_id = component_id kept from c left join n using (vec_id)"""
