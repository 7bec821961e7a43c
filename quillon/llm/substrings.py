"""Substring deduplication by level-wise doubling: words within a window that also starts elsewhere are removed.

1. Level one looks at n-grams of about a quarter of the window. Winnowing keeps an anchor of each run of
   windows: of the grams inside any one window the one of the lowest hash (the last of equals). Equal windows
   have equal anchors at equal places, so a window that repeats has an anchor that repeats; no window is lost.
2. Anchors that repeat are extended to twice the length, to either side. A window holds one of the two
   extensions whole, so anchors with neither repeated are dropped.
3. The survivors' windows, those that hold a surviving extension, are counted at full length (96-bit hashes).
   Texts that occur twice or more repeat in all their windows. One of them stands for all in the counts, and
   none needs its windows looked up again.
   Further doublings (`longest`) go on from these: a window of twice the length repeats only if both of its halves
   do, so only such starts are counted again, until no candidate survives.
4. Windows that occur twice or more are marked and the words they cover removed, judged on the input throughout.

Each level deals rows by hash, with sums taken before the shuffle; copies are counted, never paired.

Defined results: a null text has no words; repeated rows are copies of each other, so all their windows
repeat; texts shorter than a window lose nothing; each row gives a row, texts that share a doc_id or have none each
for itself; there are no ties, as every copy of a window goes; texts of any length are taken whole, in one task each
with some 20 bytes of memory a byte of text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import Words, dropped, signed, slices, written

WINDOW = 35


def levels(window: int) -> tuple[int, int]:
    """The lengths of level one and two."""
    quarter = max(1, (window + 3) // 4)
    return quarter, min(window, 2 * quarter)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of the lowest, the last of equals."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    value, place = h.copy(), np.arange(len(h))
    span = 1
    while 2 * span <= width:  # runs of a power of two, then two that overlap
        value, place = _lower(value[:-span], place[:-span], value[span:], place[span:])
        span *= 2
    rest = width - span
    return _lower(value[:n], place[:n], value[rest : rest + n], place[rest : rest + n])[1]


def _lower(v, p, w, q):
    second = (w < v) | ((w == v) & (q > p))
    return np.where(second, w, v), np.where(second, q, p)


def anchors(w: Words, window: int):
    """Of the anchors of all windows: word number, hash of the gram, and hashes of its extensions to the left and right (0 where a document ends)."""
    n, double = levels(window)
    if len(w.hash) < window:
        return (np.zeros(0, dtype=np.int64), *[np.zeros(0, dtype=np.uint64)] * 3)
    grams, wide = w.grams(n), w.grams(double)
    at = window_minima(grams, window - n + 1)
    at = np.unique(at[w.whole(window)])
    inside, more = w.whole(double), double - n
    right = np.where((at < len(wide)) & inside[np.minimum(at, len(wide) - 1)], wide[np.minimum(at, len(wide) - 1)], 0)
    left = np.where((at >= more) & inside[np.maximum(at - more, 0).clip(max=len(wide) - 1)], wide[np.maximum(at - more, 0).clip(max=len(wide) - 1)], 0)
    return at, grams[at], left.astype(np.uint64), right.astype(np.uint64)


def _anchor_rows(window: int):
    def scan(batches):
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(2)):
                w = Words(data, bounds)
                at, gram, left, right = anchors(w, window)
                doc = np.searchsorted(w.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].take(pa.array(doc)), batch.column(1)[a:b].take(pa.array(doc)), pa.array((at - w.first[doc]).astype(np.int32)), *[pa.array(signed(x)) for x in (gram, left, right)]], names=["doc_id", "h", "at", "gram", "left", "right"])

    return scan


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of [start, start + length), as sorted spans that don't touch."""
    if not len(starts):
        return []
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return [(int(x[0]), int(x[-1]) + length) for x in np.split(starts, cut)]


def _window_rows(window: int):
    """From (doc_id, h, text, ats, weight): the windows that hold an extension at one of `ats`, with two hashes each."""
    _, double = levels(window)

    def scan(batches):
        for batch in batches:
            held = batch.column(3)
            for a, b, data, bounds in slices(batch.column(2)):
                w = Words(data, bounds)
                if len(w.hash) < window:
                    continue
                inside = w.whole(window)
                mark = np.zeros(len(w.hash) + 2, dtype=np.int32)
                for i in range(a, b):
                    at = np.array(held[i].as_py(), dtype=np.int64) + w.first[i - a]
                    np.add.at(mark, np.maximum(at + double - window, 0), 1)  # starts from here ...
                    np.add.at(mark, at + 1, -1)  # ... to the extension itself
                starts = np.flatnonzero((np.cumsum(mark)[: len(inside)] > 0) & inside)
                doc = np.searchsorted(w.first, starts, side="right") - 1
                second = signed(w.grams(window, salt=2)[starts]) >> 32
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b].take(pa.array(doc)) for c in (0, 1, 4)), pa.array((starts - w.first[doc]).astype(np.int32)), pa.array(signed(w.grams(window)[starts])), pa.array(second.astype(np.int32))], names=["doc_id", "h", "weight", "start", "w1", "w2"])

    return scan


def copies(docs: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, h, text) whose text occurs twice or more: (doc_id, h, first), first marking one key for each text."""
    keyed = docs.where("text is not null").select("doc_id", "h", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    many = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("_c"), F.min(F.struct("doc_id", "h")).alias("_f")).where("_c > 1").select("k1", "k2", "_f")
    many = written(many, "many")  # a table of its own, so that the copies of a hot text can be split in the join
    return keyed.join(many.hint("shuffle_hash"), ["k1", "k2"]).select("doc_id", "h", (F.col("_f") == F.struct("doc_id", "h")).alias("first")).distinct()


def repeated_windows(docs: DataFrame, same: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of docs(doc_id, h, text), h being a hash of the text: the starts of windows that occur twice or more, as (doc_id, h, start), in words from 0. Those of the rows in `same`, see copies(), are left out: all of theirs do."""
    found = written(docs.select("doc_id", "h", "text").mapInArrow(_anchor_rows(window), "doc_id long, h int, at int, gram long, left long, right long"), "anchors")
    # Tables of their own, so that both sides of the joins below are dealt alike and a hot hash can be split.
    repeats = lambda rows, *keys: written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "repeats")
    one = written(found.join(repeats(found, "gram").hint("shuffle_hash"), "gram").select("doc_id", "h", "at", "left", "right"), "level1")
    dropped(found)
    n, double = levels(window)
    sides = one.select("doc_id", "h", (F.col("at") - (double - n)).alias("at"), F.col("left").alias("wide")).union(one.select("doc_id", "h", "at", F.col("right").alias("wide"))).where("wide <> 0")
    # A place may be an extension of two anchors and so count twice: it survives one level more than it need.
    two = sides.join(repeats(sides, "wide").hint("shuffle_hash"), "wide")
    held = written(two.groupBy("doc_id", "h").agg(F.collect_set("at").alias("ats")), "level2")
    dropped(one)
    needed = held.join(same, ["doc_id", "h"], "left").where("first is null or first").select("doc_id", "h", "ats", F.when(F.col("first"), 2).otherwise(1).alias("weight"))
    texts = docs.join(needed, ["doc_id", "h"]).select("doc_id", "h", "text", "ats", "weight")
    windows = written(texts.mapInArrow(_window_rows(window), "doc_id long, h int, weight int, start int, w1 long, w2 int"), "windows")
    dropped(held)
    many = written(windows.groupBy("w1", "w2").agg(F.sum("weight").alias("_c")).where("_c > 1").drop("_c"), "repeats")
    starts = written(windows.where("weight = 1").select("doc_id", "h", "start", "w1", "w2").join(many.hint("shuffle_hash"), ["w1", "w2"]).select("doc_id", "h", "start"), "starts")
    dropped(windows)
    return starts


def _clean_rows(keep_text: bool, window: int):
    """From (doc_id, h, text, starts, whole): words, removed words and the kept words, or their hash."""

    def scan(batches):
        for batch in batches:
            texts, starts, whole, out = batch.column(2), batch.column(3), batch.column(4), []
            for i in range(len(texts)):
                words = (texts[i].as_py() or "").encode().split()
                kept, at = [], 0
                begin = range(len(words) - window + 1) if whole[i].as_py() else starts[i].as_py() or []
                for x, y in _spans(np.array(begin, dtype=np.int64), window):
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), joined.decode() if keep_text else hashlib.sha256(joined).hexdigest()))
            n, r, k = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(k, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return scan


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the key (doc_id, h), h being 32 bits that only tell texts of one doc_id apart; for a null doc_id another hash of the text stands in, and `own` keeps what it had."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.xxhash64("text")).alias("doc_id"), F.hash("text").alias("h"), "text", own.alias("own"))


def deduplicate(docs: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_words, n_removed, kept (the remaining words joined by one space, or with keep_text=False their SHA-256)."""
    rows = _keyed(docs)
    same = written(copies(rows), "copies")
    marks = repeated_windows(rows, same, window).groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts")).withColumn("whole", F.lit(False))
    marks = marks.union(same.select("doc_id", "h", F.lit(None).cast("array<int>"), F.lit(True)))
    joined = rows.join(marks, ["doc_id", "h"], "left").select(F.col("own").alias("doc_id"), "h", "text", "starts", "whole")
    return joined.mapInArrow(_clean_rows(keep_text, window), "doc_id long, n_words long, n_removed long, kept string")


def _long_rows(length: int):
    """From (doc_id, h, text, starts): two hashes of the window of `length` words at each of the starts."""

    def scan(batches):
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(2)):
                w = Words(data, bounds)
                inside, one, two = w.whole(length), w.grams(length), w.grams(length, salt=2)
                held = [np.array(batch.column(3)[i].as_py(), dtype=np.int64) for i in range(a, b)]
                row = np.repeat(np.arange(b - a), [len(x) for x in held])
                start = np.concatenate(held) if held else np.zeros(0, np.int64)
                at = start + w.first[row]
                ok = at < len(inside)
                ok[ok] = inside[at[ok]]
                row, start, at = row[ok], start[ok], at[ok]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b].take(pa.array(row)) for c in (0, 1)), pa.array(start.astype(np.int32)), pa.array(signed(one[at])), pa.array(signed(two[at]))], names=["doc_id", "h", "start", "w1", "w2"])

    return scan


def doubled(docs: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Of docs(doc_id, h, text) and the starts of windows of `length` words that repeat: those of windows of twice that length that do."""
    second = starts.select("doc_id", "h", (F.col("start") - length).alias("start"))
    both = starts.join(second, ["doc_id", "h", "start"]).groupBy("doc_id", "h").agg(F.collect_set("start").alias("starts"))
    texts = docs.join(both, ["doc_id", "h"]).select("doc_id", "h", "text", "starts")
    windows = written(texts.mapInArrow(_long_rows(2 * length), "doc_id long, h int, start int, w1 long, w2 long"), "windows")
    many = written(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c"), "repeats")
    out = written(windows.join(many, ["w1", "w2"]).select("doc_id", "h", "start"), "starts")
    for table in (windows, many):
        dropped(table)
    return out


def longest(docs: DataFrame, window: int = WINDOW) -> list[tuple[int, int]]:
    """The doublings from `window` on: (length, windows of different texts that repeat at it), until none does. Each goes on from the survivors of the one before."""
    rows = _keyed(docs.dropDuplicates(["text"]))
    starts, out, length = repeated_windows(rows, copies(rows), window), [], window
    while n := starts.count():
        out.append((length, n))
        starts, length = doubled(rows, starts, length), 2 * length
    return out


def sql(window: int = WINDOW) -> str:
    """The same for DuckDB over the view documents, with every window at full length."""
    return f"""
with d as materialized (select row_number() over () r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []::varchar[]) w from documents),
x as materialized (select r, s, md5(array_to_string(list_slice(w, s, s + {window - 1}), ' ')) k from (select r, w, unnest(range(1, len(w) - {window - 2})) s from d where len(w) >= {window})),
again as materialized (select r, s from x where k in (select k from x group by k having count(*) > 1)),
gone as materialized (select r, list_distinct(flatten(list(range(s, s + {window})))) g from again group by r),
k as (select d.r, d.doc_id, len(w) n, case when g is null then w else list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(g, i)), lambda i: w[i]) end kept from d left join gone using (r))
select doc_id, cast(n as bigint) n_words, cast(n - len(kept) as bigint) n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k"""
