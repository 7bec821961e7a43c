"""Benchmark decontamination by greedy string tiling.

Texts and test items are sequences of words in lower case. A text and an item that share a seed, `least`
words in a row, are a candidate pair, provided that the seeds together cover enough of the item. The pair is
tiled: the longest matches that don't overlap are marked again and again, found by running Karp-Rabin hashes
of a length that falls as longer matches are used up. The share of the item under tiles is its coverage. Tiles
may lie in any order, so passages whose parts were moved about are caught too.

Seeds of the test set are looked up in each task while the test set is small (`broadcast_bytes`); larger ones
are joined by seed hash with a shuffle. Both give the same rows.

Defined results: null and empty texts have no coverage; items without an id or with fewer words than a seed are
passed over, repeated ones count once, and two texts of one item_id are two items; of equal coverages the
smallest item_id is named; repeated rows each give a row, also with a null doc_id; texts of any length are tiled
whole, in a task each, in time near proportional to them even if they repeat one word; an empty test set
contaminates nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import _BASE, _BASE_INV, Words, _powers, dropped, mix, signed, slices, whole_row, written

LEAST, COVERAGE = 4, 0.5
#: Bytes of test items up to which their seeds go to every task.
BROADCAST_BYTES = 16 << 20
START = 16


class _Sequence:
    """Word hashes with running sums, so that the hash of any run is one subtraction, and marks."""

    def __init__(self, words: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), dtype=bool)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * _powers(_BASE, len(words) + 1)[:-1])])
        self.back = _powers(_BASE_INV, len(words) + 1)

    def hash(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def runs(self, s: int) -> np.ndarray:
        """Starts of the runs of s words without a mark."""
        if len(self.words) < s:
            return np.zeros(0, np.int64)
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        return np.flatnonzero(marks[s:] == marks[:-s])

    def before(self, at: np.ndarray, none: int) -> np.ndarray:
        """The unmarked word before each place, or `none`."""
        free = (at > 0) & ~self.marked[at - 1]
        return np.where(free, self.words[at - 1], np.uint64(none))

    def room(self, at: np.ndarray) -> np.ndarray:
        """Words from each place on without a mark."""
        stop = np.where(self.marked, np.arange(len(self.words)), len(self.words))
        return np.minimum.accumulate(stop[::-1])[::-1][at] - at


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in item, start in text, length), each `least` or longer, longest first, of equal ones the first in the item, then in the text."""
    ranks = np.unique(np.concatenate([item, text]), return_inverse=True)[1].astype(np.uint64) + np.uint64(3)  # so that 1 and 2 are no words
    a, b, out = _Sequence(ranks[: len(item)]), _Sequence(ranks[len(item) :]), []
    s = max(least, min(START, len(item)))
    while True:
        i, j, n = _matches(a, b, s)
        while len(n):  # each turn uses up `s` words of the item, so turns are few, and all matches are held against the new tile at once
            top = np.flatnonzero(n == n.max())
            k = top[np.lexsort((j[top], i[top]))[0]]
            x, y, size = int(i[k]), int(j[k]), int(n[k])
            a.marked[x : x + size] = b.marked[y : y + size] = True
            out.append((x, y, size))
            i, j, n = _cut(i, j, n, x, y, size, s)
        if s == least:
            return out
        s = max(least, s // 2)


def _cut(i, j, n, x: int, y: int, size: int, s: int):
    """What a new tile leaves of matches (i, j, n): the parts of s words or more outside it, at most three of each."""
    ends = []
    for start, tile in ((i, x), (j, y)):
        lo, hi = np.clip(tile - start, 0, n), np.clip(tile + size - start, 0, n)
        ends.append((np.where(lo < hi, lo, n), np.where(lo < hi, hi, n)))
    (lo1, hi1), (lo2, hi2) = ends
    first, second = np.minimum(lo1, lo2), np.maximum(lo1, lo2)
    parts = [(np.zeros_like(n), first), (np.where(lo1 <= lo2, hi1, hi2), second), (np.maximum(hi1, hi2), n)]
    # Where one lies within the other the middle part is empty or lies within what is taken; the last part starts after both.
    kept = [(i + lo, j + lo, hi - lo) for lo, hi in parts]
    i, j, n = (np.concatenate(c) for c in zip(*kept))
    long = n >= s
    return i[long], j[long], n[long]


def _matches(a: _Sequence, b: _Sequence, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unmarked matches of s words or more that can be prolonged to neither side: starts in a and b, and lengths.

    The runs of b lie in the order of their hash and the word before. A run of a meets those of its hash with
    another word before; the others are prolongations of matches further left. So a text that repeats one
    passage costs as many pairs as it has words, not that number squared.
    """
    at_a, at_b = a.runs(s), b.runs(s)
    if not len(at_a) or not len(at_b):
        return (np.zeros(0, np.int64),) * 3
    hash_a, hash_b = a.hash(at_a, s), b.hash(at_b, s)
    both = np.isin(hash_b, hash_a)
    at_b, hash_b = at_b[both], hash_b[both]
    prev_a, prev_b = a.before(at_a, 1), b.before(at_b, 2)
    order = np.lexsort((prev_b, hash_b))
    at_b, hash_b, prev_b = at_b[order], hash_b[order], prev_b[order]
    lo, hi = np.searchsorted(hash_b, hash_a, "left"), np.searchsorted(hash_b, hash_a, "right")
    keep = hi > lo
    at_a, prev_a, lo, hi = at_a[keep], prev_a[keep], lo[keep], hi[keep]
    same = [[x + int(np.searchsorted(prev_b[x:y], p, side)) for x, y, p in zip(lo.tolist(), hi.tolist(), prev_a)] for side in ("left", "right")]
    begin, end = np.concatenate([lo, np.array(same[1], dtype=np.int64)]), np.concatenate([np.array(same[0], dtype=np.int64), hi])
    count = end - begin
    i = np.repeat(np.tile(at_a, 2), count)
    j = at_b[np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())]
    low, high = np.full(len(i), s, dtype=np.int64), np.minimum(a.room(i), b.room(j))
    low = np.minimum(low, high)
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo] + 1) // 2
        equal = a.hash(i[todo], middle) == b.hash(j[todo], middle)
        low[todo] = np.where(equal, middle, low[todo])
        high[todo] = np.where(equal, high[todo], middle - 1)
    return i, j, low


def coverage(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> float:
    return sum(n for _, _, n in tiles(item, text, least)) / max(1, len(item))


class Items:
    """The words of test items and an index of their seeds."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        self.ids, self.words, seeds, item, place = [], [], [], [], []
        for i, text in sorted(zip(ids, texts)):
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            w = Words(data, np.array([0, len(data)]), lower=True)
            if len(w.hash) < least:
                continue
            grams = w.grams(least)
            seeds.append(grams)
            item.append(np.full(len(grams), len(self.ids)))
            place.append(np.arange(len(grams)))
            self.ids.append(i)
            self.words.append(w.hash)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        seeds, item, place = join(seeds, np.uint64), join(item, np.int64), join(place, np.int64)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.item, self.place = seeds[order], item[order], place[order]
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[(self.seeds & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places in grams that are seeds."""
        maybe = np.flatnonzero(self.some[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.seeds):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.seeds, grams[maybe])
        return maybe[(at < len(self.seeds)) & (self.seeds[np.minimum(at, len(self.seeds) - 1)] == grams[maybe])]

    def candidates(self, grams: np.ndarray, least: int, share: float) -> list[int]:
        """Items of which the seeds among grams cover the share."""
        grams = np.unique(grams)
        lo, hi = np.searchsorted(self.seeds, grams, "left"), np.searchsorted(self.seeds, grams, "right")
        flat = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(lo, hi)])) if len(grams) else np.zeros(0, np.int64)
        out = []
        for i in np.unique(self.item[flat]):
            covered = np.zeros(len(self.words[i]), dtype=bool)
            for p in self.place[flat[self.item[flat] == i]]:
                covered[p : p + least] = True
            if covered.sum() >= share * len(covered):
                out.append(int(i))
        return out


def _looked_up(items: Items, least: int, share: float):
    """From (doc_id, text): doc_id and the items found with their coverage."""

    def scan(batches):
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                w = Words(data, bounds, lower=True)
                grams, whole = w.grams(least), w.whole(least)
                found = [[] for _ in range(b - a)]
                at = items.hits(grams)
                at = at[whole[at]]
                doc = np.searchsorted(w.first, at, side="right") - 1
                for d in np.unique(doc):
                    text = w.hash[w.first[d] : w.first[d + 1]]
                    for i in items.candidates(grams[at[doc == d]], least, share):
                        if (c := coverage(items.words[i], text, least)) >= share:
                            found[d].append({"item_id": items.ids[i], "coverage": c})
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(found, pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())])))], names=["doc_id", "found"])

    return scan


#: Bits of the filter that documents' seeds must pass before they are shuffled: 16 MB, whatever the test set.
FILTER_BITS = 1 << 27
#: Keys of candidate documents (24 bytes each) up to which they are broadcast to the texts.
BROADCAST_KEYS = 250_000


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """Of a table of seeds, the bits that some seed has, as bytes. Spark sets the bits in buckets of fixed size, of which the driver gets FILTER_BITS / 32768 at most."""
    bit = F.col("seed").bitwiseAND(FILTER_BITS - 1) + 1
    buckets = seeds.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in buckets:
        part = np.frombuffer(r["bits"], dtype=np.uint8)
        out[(r["b"] - 1) * len(part) : r["b"] * len(part)] = part
    return out


def _seed_rows(least: int, bits=None):
    """From (key.., text) with the key in column 0: key, place in words, seed, words of the text. bits: a broadcast of _filter_of(), for only the seeds that pass it, once a text."""

    def scan(batches):
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(1)):
                w = Words(data, bounds, lower=True)
                grams = w.grams(least)
                at = np.flatnonzero(w.whole(least))
                if bits is not None:
                    bit = (grams[at] & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    at = at[(bits.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                doc = np.searchsorted(w.first, at, side="right") - 1
                if bits is not None and len(at):
                    once = np.unique(np.stack([doc.astype(np.uint64), grams[at]]), axis=1, return_index=True)[1]
                    at, doc = at[once], doc[once]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(signed(grams[at])), pa.array(np.diff(w.first)[doc].astype(np.int32))], names=["k", "place", "seed", "n"])

    return scan


def _tiled(least: int):
    """From (k, item_id, item text, text): k, item_id, coverage."""

    def scan(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                pair = [np.frombuffer(x.encode(), dtype=np.uint8) for x in (item, text)]
                out.append(coverage(*(Words(d, np.array([0, len(d)]), lower=True).hash for d in pair), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["k", "item_id", "coverage"])

    return scan


def _items(benchmark: DataFrame, least: int, broadcast_bytes: int) -> tuple[DataFrame, Items | None]:
    """The test items, and their index if they are small."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).distinct()
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > broadcast_bytes:
        return items, None
    held = items.collect()
    return items, Items([r["item_id"] for r in held], [r["text"] for r in held], least)


def find(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, contaminated, item_id and coverage of the item most covered, n_items (those covered by `share` or more)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    items, known = _items(benchmark, least, broadcast_bytes)
    if known:
        found = rows.mapInArrow(_looked_up(known, least, share), "doc_id long, found array<struct<item_id:long,coverage:double>>")
    else:
        found = _joined(rows, items, least, share)
    best = F.array_min(F.transform("found", lambda x: F.struct((-x["coverage"]).alias("worst"), x["item_id"].alias("item_id"))))
    return found.withColumn("_b", best).select("doc_id", (F.size("found") > 0).alias("contaminated"), F.col("_b.item_id").alias("item_id"), F.coalesce(-F.col("_b.worst"), F.lit(0.0)).alias("coverage"), F.size("found").cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated."""
    items, known = _items(benchmark, least, broadcast_bytes)
    if known:
        look = _looked_up(known, least, share)

        @F.pandas_udf("boolean")
        def contaminated(text):
            batch = pa.RecordBatch.from_arrays([pa.nulls(len(text), pa.int64()), pa.Array.from_pandas(text, type=pa.string())], names=["doc_id", "text"])
            return pd.Series([len(f) > 0 for part in look([batch]) for f in part.column(1).to_pylist()], dtype=bool)

        return docs.where(~contaminated(F.lower("text")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.lower("text")).alias("h"))
    bad = _pairs(rows.withColumn("k", key), items, least, share).select("k").distinct()
    bad = _few(bad)
    return docs.select(whole_row(docs).alias("row"), key.alias("k")).join(bad, "k", "left_anti").select("row.*")


def _pairs(keyed: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    """For large test sets: seeds meet in a shuffle join, then each candidate pair is tiled. Gives k, item_id, coverage."""
    columns, items = "place int, seed long, n int", items.withColumn("item", F.struct("item_id", F.xxhash64("text").alias("h")))
    theirs = items.select("item", "text").mapInArrow(_seed_rows(least), f"k struct<item_id:long,h:long>, {columns}").select(F.col("k").alias("item"), "place", "seed", "n")
    theirs = written(theirs, "seeds")  # a table of its own, so that a hot seed is split in the join
    bits = keyed.sparkSession.sparkContext.broadcast(_filter_of(theirs))
    ours = keyed.select("k", "text").mapInArrow(_seed_rows(least, bits), f"k struct<d:long,h:long>, {columns}").select("k", "seed").distinct()
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("place", F.col("place") + (least - 1))))))
    pairs = written(ours.join(theirs, "seed").groupBy("k", "item", "n").agg(covered.alias("c")).where(F.col("c") >= share * F.col("n")).select("k", "item"), "pairs")
    dropped(theirs)
    texts = keyed.select("k", "text").join(_few(pairs.select("k").distinct()), "k", "left_semi").dropDuplicates(["k"])
    ready = pairs.join(texts, "k").join(items.withColumnRenamed("text", "theirs"), "item").select("k", "item_id", "theirs", "text")
    tiled = written(ready.mapInArrow(_tiled(least), "k struct<d:long,h:long>, item_id long, coverage double").where(F.col("coverage") >= share), "tiled")
    dropped(pairs)
    return tiled


def _few(keys: DataFrame) -> DataFrame:
    """Keys that are broadcast where they are few, so that whole texts needn't be moved to meet them."""
    keys = written(keys, "keys")
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _joined(rows: DataFrame, items: DataFrame, least: int, share: float) -> DataFrame:
    keyed = rows.withColumn("k", F.struct(F.coalesce("doc_id", F.lit(0)).alias("d"), F.xxhash64("text").alias("h")))
    found = _pairs(keyed, items, least, share).groupBy("k").agg(F.collect_list(F.struct("item_id", "coverage")).alias("found"))
    return keyed.join(found, "k", "left").select("doc_id", F.coalesce("found", F.array().cast("array<struct<item_id:bigint,coverage:double>>")).alias("found"))
