"""Vector code compression: product codes from codebooks that filtering Lloyd rounds improve.

Vectors become integers, floor(4096 x), and are cut into PARTS equal parts; each part position has a codebook.

1. Every task builds kd-trees over the parts of its vectors: runs of up to CHUNK vectors, a tree for each part
   position. A tree halves its points at the median of the widest side, down to LEAF points. Each node keeps
   its bounding box, and the sums and the count of its points. The trees are written once as a table.
2. A round takes the codebooks (a table of fixed size) to the trees. From the root on, a node holds the entries that may
   be the nearest of some point in its box. The entry nearest to the box's centre eliminates every other one that is
   farther, or as far and higher in order, from each corner and so from each point of the box; a distance difference
   is linear in the point, so one corner decides. A node with one entry left gives it its cached sums and count at once,
   whole subtrees together; leaves with more compare their points. Tasks give back sums and counts by entry.
3. After the last round the same descent gives each vector its codes, and its error.

All arithmetic is in integers, so elimination and ties are exact.

Defined results: a vector that is null, empty or holds null or non-finite components is dropped. Vectors shorter than the
longest, or than its length made up to a multiple of PARTS, count as filled up with zeros. Integers are held within
a bound that keeps every distance in 62 bits (some 2^28 for 64 components, so |x| up to 65,536). Rows that share a
vec_id each give a row and are ordered by their vectors where codebooks start; null vec_ids come last there. With fewer than ENTRIES
vectors the codebooks have as many entries as there are vectors. A label_error that no long holds is null. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import OFFSET_ROWS, dropped, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors in a tree, and points up to which a node is a leaf.
CHUNK, LEAF = 4096, 16


def bound(width: int) -> int:
    """The largest absolute integer component, so that a vector's squared distance is below 2^62."""
    return math.isqrt((1 << 60) // width)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of `width` integers."""
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    most = bound(width)
    with np.errstate(over="ignore"):
        flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * SCALE)
    out[np.arange(width) < lengths[:, None]] = np.clip(flat, -most, most).astype(np.int64)
    return out


class Tree:
    """A kd-tree over points, as arrays: `order` of the points, and for each level the first point of its nodes (one more at the end), their boxes and sums.

    All nodes of a level halve together: `order` keeps a node's points side by side.
    """

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order, firsts = np.arange(n), np.array([0, n])
        self.firsts = [firsts]
        while n and np.diff(firsts).max() > LEAF:
            at = points[self.order]
            widest = np.argmax(np.maximum.reduceat(at, firsts[:-1]) - np.minimum.reduceat(at, firsts[:-1]), axis=1)
            node = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            self.order = self.order[np.lexsort((at[np.arange(n), widest[node]], node))]
            firsts = np.unique(np.concatenate([firsts, (firsts[:-1] + firsts[1:]) // 2]))
            self.firsts.append(firsts)
        self.points = points[self.order]
        self.cache()

    def cache(self) -> None:
        sums = np.concatenate([np.zeros((1, self.points.shape[1]), np.int64), np.cumsum(self.points, axis=0)])
        self.low = [np.minimum.reduceat(self.points, f[:-1]) for f in self.firsts]
        self.high = [np.maximum.reduceat(self.points, f[:-1]) for f in self.firsts]
        self.sums = [sums[f[1:]] - sums[f[:-1]] for f in self.firsts]


def _children(firsts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each node of the next level its node in this one."""
    return np.searchsorted(firsts, below[:-1], side="right") - 1


def survivors(held: np.ndarray, low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Of the entries that nodes hold (nodes x entries), those that may be nearest to a point of the node's box."""
    far = np.iinfo(np.int64).max
    # Twice the centre, so that it is a whole number; its own square is the same for all entries.
    norms = (book**2).sum(axis=1)
    to_centre = np.where(held, norms - (low + high) @ book.T, far)
    best = to_centre.argmin(axis=1)  # the first of equals
    step = book[None, :, :] - book[best][:, None, :]
    corner = np.where(step > 0, high[:, None, :], low[:, None, :])
    least = norms[None, :] - norms[best][:, None] - 2 * (corner * step).sum(axis=2)  # the least of an entry's distance less the best one's
    entry = np.arange(len(book))
    out = held & ~((least > 0) | ((least == 0) & (entry[None, :] > best[:, None])))
    out[np.arange(len(best)), best] = True
    return out


def descend(tree: Tree, book: np.ndarray):
    """Yields what the tree decides: (entry, first point, end, sums or None) for subtrees as wholes; then (entries, points) arrays for points of leaves."""
    nodes = np.zeros(1, dtype=np.int64)
    held = np.ones((1, len(book)), dtype=bool)
    for level, firsts in enumerate(tree.firsts):
        held = survivors(held, tree.low[level][nodes], tree.high[level][nodes], book)
        alone = held.sum(axis=1) == 1
        if alone.any():
            n = nodes[alone]
            yield "nodes", held[alone].argmax(axis=1), firsts[n], firsts[n + 1], tree.sums[level][n]
        nodes, held = nodes[~alone], held[~alone]
        if not len(nodes):
            return
        if level + 1 < len(tree.firsts):
            up = _children(firsts, tree.firsts[level + 1])
            slot = np.full(len(firsts) - 1, -1)
            slot[nodes] = np.arange(len(nodes))
            below = np.flatnonzero(slot[up] >= 0)
            nodes, held = below, held[slot[up[below]]]
    firsts = tree.firsts[-1]
    size = firsts[nodes + 1] - firsts[nodes]
    of = np.repeat(np.arange(len(nodes)), size)
    at = np.repeat(firsts[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
    points = tree.points[at]
    distance = np.where(held[of], (book**2).sum(axis=1) - 2 * points @ book.T, np.iinfo(np.int64).max)
    yield "points", distance.argmin(axis=1), at, None, points


def totals(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the points by their nearest entry."""
    sums, counts = np.zeros_like(book), np.zeros(len(book), dtype=np.int64)
    for kind, entry, first, end, part in descend(tree, book):
        np.add.at(sums, entry, part)
        np.add.at(counts, entry, end - first if kind == "nodes" else 1)
    return sums, counts


def nearest(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and its squared distance, in the points' first order."""
    code = np.zeros(len(tree.order), dtype=np.int64)
    for kind, entry, first, end, _ in descend(tree, book):
        if kind == "nodes":
            size = end - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            code[at] = np.repeat(entry, size)
        else:
            code[first] = entry
    out, error = np.empty_like(code), np.empty_like(code)
    out[tree.order] = code
    error[tree.order] = ((tree.points - book[code]) ** 2).sum(axis=1)
    return out, error


# --- trees as rows ---------------------------------------------------------------------------------

_TREES = "ids array<long>, labels array<string>, orders binary, points binary"
_ROW = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("orders", pa.binary()), ("points", pa.binary())])


def _build(width: int):
    """From (vec_id, label, embedding): a row per run of vectors with the trees of all part positions; where nodes begin follows from the number of points alone."""

    def rows(ids, labels, held):
        trees = [Tree(p) for p in np.split(np.concatenate(held), PARTS, axis=1)]
        orders = np.stack([t.order for t in trees]).astype("<u2")
        points = np.stack([t.points for t in trees]).astype("<i4")
        return pa.RecordBatch.from_pylist([{"ids": ids, "labels": labels, "orders": orders.tobytes(), "points": points.tobytes()}], schema=_ROW)

    def scan(batches):
        ids, labels, held, n = [], [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, CHUNK - n)
                ids, labels = ids + part.column(0).to_pylist(), labels + part.column(1).to_pylist()
                held.append(integers(part.column(2), width))
                n, at = n + part.num_rows, at + part.num_rows
                if n == CHUNK:
                    yield rows(ids, labels, held)
                    ids, labels, held, n = [], [], [], 0
        if n:
            yield rows(ids, labels, held)

    return scan


def _trees(n: int, orders: bytes, points: bytes):
    """The trees of a row, boxes and sums rebuilt from the points as they stand."""
    orders = np.frombuffer(orders, "<u2").reshape(PARTS, n)
    points = np.frombuffer(points, "<i4").reshape(PARTS, n, -1)
    firsts = [np.array([0, n])]
    while np.diff(firsts[-1]).max() > LEAF:
        firsts.append(np.unique(np.concatenate([firsts[-1], (firsts[-1][:-1] + firsts[-1][1:]) // 2])))
    for part in range(PARTS):
        tree = Tree.__new__(Tree)
        tree.order, tree.firsts, tree.points = orders[part].astype(np.int64), firsts, points[part].astype(np.int64)
        tree.cache()
        yield tree


def _sum_rows(books: np.ndarray):
    """One row a task, part and entry: sums and count."""

    def scan(batches):
        sums, counts = np.zeros_like(books), np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for part, tree in enumerate(_trees(*(c[i].as_py() for c in batch.columns))):
                    s, c = totals(tree, books[part])
                    sums[part] += s
                    counts[part] += c
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return scan


def _code_rows(books: np.ndarray):
    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, n = batch.column(0).slice(i, 1).flatten(), len(batch.column(0)[i])
                found = [nearest(t, books[p]) for p, t in enumerate(_trees(n, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()))]
                codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(i, 1).flatten(), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    return scan


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that are kept."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding").where(good)


def codebooks(trees: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (part, entry, component) after the rounds. The driver gets sums by part and entry, a table of fixed size."""
    width = books.shape[2]
    for _ in range(rounds):
        each = trees.select(F.size("ids"), "orders", "points")
        found = each.mapInArrow(_sum_rows(books), "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
        books = books.copy()
        # A task's sums fit a long; those of the whole corpus may not.
        for r in found.agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]).collect():
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return books


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per kept row of vectors(vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256; and the codebooks."""
    kept = valid(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").toArrow().column(0).combine_chunks()
    books = integers(first, width).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    trees = written(kept.mapInArrow(_build(width), _TREES), "trees")
    books = codebooks(trees, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = written(trees.mapInArrow(_code_rows(books), "vec_id long, label string, code string, error long"), "codes")
    dropped(trees)
    sums = written(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")).select(F.col("label").alias("_l"), F.expr("try_cast(label_error as bigint)").alias("label_error")), "sums")
    # Few labels go to every task; many, so small ones, meet their rows by a shuffle in which a hot label can be split.
    sums = F.broadcast(sums) if sums.count() <= OFFSET_ROWS else sums.hint("shuffle_hash")
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("_l"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
    return out, books


def sql(rounds: int = ROUNDS) -> str:
    """The same for DuckDB over the view embeddings, for vectors of one length: plain Lloyd rounds that hold every part against every entry."""
    floor_div = "(s - ((s % n) + n) % n) // n"
    assign = lambda k: f"a{k} as materialized (select v, p, x, e, d from (select v, q.p, q.x, b.e, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: (q.x[i] - b.x[i]) * (q.x[i] - b.x[i]))) d from q join b{k} b on b.p = q.p) qualify row_number() over (partition by v, p order by d, e) = 1)"
    steps = [assign(0)]
    for k in range(rounds):
        steps.append(f"m{k} as (select p, e, i, cast(sum(x[i]) as bigint) s, count(*) n from (select p, e, x, unnest(range(1, len(x) + 1)) i from a{k}) group by p, e, i)")
        steps.append(f"u{k} as (select p, e, list({floor_div} order by i) x from m{k} group by p, e)")
        steps.append(f"b{k + 1} as materialized (select b.p, b.e, coalesce(u.x, b.x) x from b{k} b left join u{k} u on u.p = b.p and u.e = b.e)")
        steps.append(assign(k + 1))
    return f"""
with g as materialized (select row_number() over () v, vec_id, label, list_transform(embedding, lambda c: cast(floor({SCALE}::double * c) as bigint)) x from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
q as materialized (select v, p, x[p * len(x) // {PARTS} + 1 : (p + 1) * len(x) // {PARTS}] x from g, range({PARTS}) r(p)),
f as (select v, row_number() over (order by vec_id nulls last, x) - 1 e from g qualify e < {ENTRIES}),
b0 as materialized (select q.p, f.e, q.x from f join q using (v)),
{", ".join(steps)},
k as (select sha256(string_agg(c, ',' order by p, e)) h from (select p, e, list_aggregate(x, 'string_agg', ',') c from b{rounds})),
r as (select v, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from a{rounds} group by v)
select g.vec_id, r.code, r.error, cast(sum(r.error) over (partition by g.label) as bigint) label_error, k.h codebooks_sha256 from g join r using (v), k"""
