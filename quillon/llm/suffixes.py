"""Suffix-array deduplication: bytes covered by a string of LENGTH bytes that also starts earlier are removed.

1. Windows of LENGTH bytes are dealt by content. Of the GRAM-byte grams in a window the one of the lowest hash (the last of
   equals) is its anchor; equal windows have equal anchors at equal places. Neighbouring windows that share an
   anchor form one string; its key is the anchor's hash. So windows of different keys never match, and keys that occur once
   are dropped.
2. Strings that are equal are one, with its least place (document, start): all others' windows start earlier there. This is an
   aggregate, so the copies of a frequent passage aren't gathered.
3. The different strings of a key form a collection; tasks take whole keys, up to COLLECTION strings at a time, and build the collection's
   Burrows-Wheeler transform and longest common prefixes column by column, see `Collection`: round j inserts the
   suffix of length j of every string, one symbol per string, and rewrites both sequences from front to back. Neighbours
   in suffix order that share LENGTH bytes are equal windows; all but the one of the least place are marked.
4. A key of more than MOST_STRINGS different strings (a short passage in a great many contexts) is no collection of bounded size:
   its windows are counted one by one, by hash, in an aggregate.
5. Marks meet their texts, which are cut.

Each round reads and writes its sequences in order only. They stand in memory, as a task's collections have a bounded size
(some 150 entries of three bytes a string); what is outside memory are the written tables between the steps.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; documents are ordered by doc_id, texts that share a doc_id by hash,
and those without one come last, by hash; rows that share doc_id and text are one document and each gives its row; texts of any length are
taken whole, in a task each, and scanned in pieces of bounded size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import _BASE, _BASE_INV, _BYTE, SLICE_BYTES, _powers, dropped, mix, signed, slices, written
from quillon.llm.substrings import window_minima

LENGTH, GRAM = 100, 48
COLLECTION, MOST_STRINGS = 2048, 4096
#: Documents without a doc_id get numbers from here on, so that they come last.
NO_ID = 1 << 62


# --- step 1: strings -------------------------------------------------------------------------------

def strings_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Of texts (their bytes, and their offsets in it): first window, number of windows, key, and hash, of every run of windows that share an anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    power, back = _powers(_BASE, len(data) + 1), _powers(_BASE_INV, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power[:-1], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1])
    anchor = window_minima(grams, length - gram + 1)
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends
    follows = np.zeros(len(anchor), dtype=bool)
    follows[1:] = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1])
    first = np.flatnonzero(valid & ~follows)
    last = np.flatnonzero(valid & ~np.append(follows[1:], False))
    end = last + length
    return first, last - first + 1, grams[anchor[first]], mix((sums[end] - sums[first]) * back[first] + (end - first).astype(np.uint64))


def _string_keys(length: int, gram: int):
    """From (d, h, text): a row per string, with its key and hash; together these have 128 bits."""

    def rows(batch, a, b, data, bounds, shift):
        first, n, key, content = strings_of(data, bounds, length, gram)
        doc = np.searchsorted(bounds, first, side="right") - 1
        start = first - bounds[doc] + shift
        return pa.RecordBatch.from_arrays([*(batch.column(c)[a:b].take(pa.array(doc)) for c in (0, 1)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(signed(key)), pa.array(signed(content))], names=["d", "h", "start", "n", "key", "content"])

    def scan(batches):
        for batch in batches:
            for a, b, data, bounds in slices(batch.column(2)):
                if b - a > 1 or len(data) <= 2 * SLICE_BYTES:
                    yield rows(batch, a, b, data, bounds, 0)
                else:
                    for x in range(0, len(data) - length + 1, SLICE_BYTES):
                        piece = data[x : x + SLICE_BYTES + length - 1]
                        yield rows(batch, a, b, piece, np.array([0, len(piece)]), x)

    return scan


def _string_bytes(length: int):
    """From (d, h, text, held: list of start, n, key, hot): the strings' bytes; of hot keys each window apart, as a 16-byte hash."""

    def scan(batches):
        names, kinds = ["d", "h", "start", "n", "key", "hot", "string"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        out, size = [[] for _ in names], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                d, h, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py().encode()
                held = batch.column(3).slice(i, 1).flatten()
                for start, n, key, hot in zip(*(held.field(k).to_pylist() for k in range(4))):
                    if hot:
                        values = [(d, h, s, 1, key, True, hashlib.blake2b(data[s : s + length], digest_size=16).digest()) for s in range(start, start + n)]
                    else:
                        values = [(d, h, start, n, key, False, data[start : start + n + length - 1])]
                    for row in values:
                        for column, value in zip(out, row):
                            column.append(value)
                    size += n + length
                    if size > SLICE_BYTES:
                        yield flush()
                        out, size = [[] for _ in names], 0
        if out[0]:
            yield flush()

    return scan


# --- step 3: collections ---------------------------------------------------------------------------


class Collection:
    """Burrows-Wheeler transform and longest common prefixes of many strings, built by inserting one symbol per string and round.

    Round 0 holds the empty suffix of every string, in the strings' order; `bwt` has each suffix's preceding symbol (0: none). Round j
    inserts the suffixes of length j. Where one belongs follows from where the suffix of length j - 1 stands, by counting its
    preceding symbol up to there. A suffix shares with the one before it one symbol more than the suffixes behind their first symbols do,
    which is a minimum over a stretch of last round's prefixes.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        """data: the strings' bytes one after another (UTF-8, so none is 255); bounds: their offsets in it."""
        data = np.append(data + np.uint8(1), np.uint8(0))  # symbols from 1 on
        self.ends, self.lengths = bounds[1:], np.diff(bounds)
        self.strings = m = len(self.lengths)
        symbol = lambda who, j: np.where(self.lengths[who] > j, data[np.maximum(self.ends[who] - j - 1, 0)], 0).astype(np.uint8)  # noqa: E731  what precedes the suffix of length j
        self.bwt, self.lcp = symbol(np.arange(m), 0), np.zeros(m, dtype=np.uint16)
        owner, fresh = np.arange(m), np.ones(m, dtype=bool)  # owner is right for entries of the last round
        for j in range(1, int(self.lengths.max(initial=0)) + 1):
            source, of = self.sources()
            new = fresh[source]
            who = owner[source[new]]
            size = m + len(source)
            bwt, lcp, owner, fresh = np.empty(size, np.uint8), np.zeros(size, np.uint16), np.zeros(size, np.int64), np.zeros(size, bool)
            bwt[:m] = self.bwt[:m]
            bwt[m:][~new], lcp[m:][~new] = self.bwt[m:], self.lcp[m:]
            bwt[m:][new] = symbol(who, j)
            owner[m:][new], fresh[m:] = who, new
            touched = new.copy()
            touched[1:] |= new[:-1]
            lcp[m:][touched] = self._prefixes(source, of, np.flatnonzero(touched))
            self.bwt, self.lcp = bwt, lcp

    def sources(self):
        """For the suffixes of next round, in order, but for the empty ones: the entry that each lengthens; and its first symbol."""
        order = np.argsort(self.bwt, kind="stable")
        order = order[np.count_nonzero(self.bwt == 0) :]
        return order, self.bwt[order]

    def _prefixes(self, source, of, at):
        """Longest common prefix of the suffixes `at` with those before them."""
        out = np.zeros(len(at), dtype=np.uint16)
        inner = np.flatnonzero((at > 0) & (of[at] == of[at - 1]))
        inner = inner[np.argsort(-source[at[inner]], kind="stable")]  # from the back, so that nothing between two stretches is read
        if len(inner):
            stretch = np.empty(2 * len(inner), dtype=np.int64)
            stretch[0::2], stretch[1::2] = source[at[inner] - 1] + 1, source[at[inner]] + 1
            out[inner] = np.minimum.reduceat(np.append(self.lcp, np.uint16(0)), stretch)[0::2] + 1
        return out

    def windows(self, length: int):
        """Of all suffixes of `length` or more symbols: string, start in it, and a number that equal prefixes of `length` share."""
        number = np.cumsum(self.lcp < length)
        source, _ = self.sources()
        to = np.zeros(len(self.bwt), dtype=np.int64)
        to[source] = self.strings + np.arange(len(source))
        at, who, out = np.arange(self.strings), np.arange(self.strings), []
        for j in range(1, int(self.lengths.max(initial=0)) + 1):
            going = self.lengths[who] >= j
            who, at = who[going], to[at[going]]
            if j >= length:
                out.append((who, self.lengths[who] - j, number[at]))
        return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def repeated(data: np.ndarray, bounds: np.ndarray, rank: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """String and start of the windows that also start in a string of lower rank."""
    who, start, number = Collection(data, bounds).windows(length)
    order = np.lexsort((rank[who], number))
    who, start, number = who[order], start[order], number[order]
    again = np.zeros(len(who), dtype=bool)
    again[1:] = number[1:] == number[:-1]
    return who[again], start[again]


def _collections(length: int):
    """From strings sorted by key: (d, h, start, n) of runs of windows that start earlier."""

    def done(parts):
        rows = pa.Table.from_batches(parts).combine_chunks()
        d, h, start = (np.asarray(rows.column(c).combine_chunks() if isinstance(rows.column(c), pa.ChunkedArray) else rows.column(c)) for c in ("d", "h", "start"))
        strings = rows.column("string").to_pylist()
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
        rank = np.empty(len(d), dtype=np.int64)
        rank[np.lexsort((start, h, d))] = np.arange(len(d))
        who, at = repeated(np.frombuffer(b"".join(strings), dtype=np.uint8), bounds, rank, length)
        order = np.lexsort((at, who))
        who, at = who[order], at[order]
        begin = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1))) if len(who) else np.zeros(0, np.int64)
        n = np.diff(np.append(begin, len(who)))
        who, at = who[begin], at[begin]
        return pa.RecordBatch.from_arrays([pa.array(d[who]), pa.array(h[who]), pa.array((start[who] + at).astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "h", "start", "n"])

    def scan(batches):
        parts, held = [], 0
        for batch in batches:
            key = np.asarray(batch.column(0))
            new = np.flatnonzero(np.append(not parts or parts[-1].column(0)[-1].as_py() != key[0], key[1:] != key[:-1])) if len(key) else []
            at = 0
            for cut in new:
                if held + cut - at >= COLLECTION:
                    parts, held = [*parts, batch.slice(at, cut - at)] if cut > at else parts, 0
                    yield done(parts)
                    parts, at = [], cut
            if len(key) > at:
                parts.append(batch.slice(at))
                held += len(key) - at
        if parts:
            yield done(parts)

    return scan


# --- the whole -------------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with their place among documents, (d, h)."""
    own = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("text"), 2)).alias("d"), F.hash("text").alias("h"), "text", own.alias("doc_id"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_STRINGS) -> DataFrame:
    """Of docs(d, h, text): (d, h, start, n) of runs of n windows, from byte `start` on, that start earlier, too."""
    found = written(docs.select("d", "h", "text").mapInArrow(_string_keys(length, gram), "d long, h int, start int, n int, key long, content long"), "strings")
    place = F.struct("d", "h", "start")
    keys = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key"), "keys")
    again = written(found.join(keys.hint("shuffle_hash"), "key"), "again")  # both sides are tables, so that a hot key can be split
    for table in (found, keys):
        dropped(table)
    firsts = written(again.groupBy("key", "content", "n").agg(F.min(place).alias("p")).select("key", "n", "p.*"), "firsts")
    sizes = written(firsts.groupBy("key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("key", (F.col("_c") > most).alias("hot")), "sizes")
    held = written(firsts.join(sizes.hint("shuffle_hash"), "key").groupBy("d", "h").agg(F.collect_set(F.struct("start", "n", "key", "hot")).alias("held")), "held")
    strings = written(docs.dropDuplicates(["d", "h"]).join(held, ["d", "h"]).select("d", "h", "text", "held").mapInArrow(_string_bytes(length), "d long, h int, start int, n int, key long, hot boolean, string binary"), "bytes")
    dropped(held)
    copies = again.join(firsts.select("d", "h", "start"), ["d", "h", "start"], "left_anti").select("d", "h", "start", "n")
    sorted_ = strings.where("not hot").select("key", "d", "h", "start", "string").repartition("key").sortWithinPartitions("key")
    inside = sorted_.mapInArrow(_collections(length), "d long, h int, start int, n int")
    windows = strings.where("hot")
    least = windows.groupBy("string").agg(F.min(place).alias("p")).select("p.*")
    apart = windows.select("d", "h", "start", "n").join(least, ["d", "h", "start"], "left_anti")
    out = written(copies.unionByName(inside).unionByName(apart), "marks")
    for table in (again, firsts, sizes, strings):
        dropped(table)
    return out


def cut(data: bytes, start: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[bytes, int]:
    """The bytes outside the windows, and the number of maximal runs that went."""
    if not len(start):
        return data, 0
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate(start[order] + n[order] + length - 1)
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    begin, end = begin[new], end[np.append(new[1:], len(end)) - 1]
    kept = [data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)])]
    return b"".join(kept), len(new)


def _clean_rows(length: int, keep: bool):
    def scan(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode()
                marks = batch.column(2).slice(i, 1).flatten()
                left, spans = cut(data, *(np.asarray(marks.field(k), dtype=np.int64) for k in (0, 1)), length)
                out.append((len(data), len(data) - len(left), spans, left if keep else hashlib.sha256(left).hexdigest().encode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return scan


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_STRINGS, keep: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes, which may end within a character; with keep=False the hex digits of their SHA-256)."""
    rows = _keyed(docs)
    marks = repeats(rows, length, gram, most).groupBy("d", "h").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    joined = rows.join(marks, ["d", "h"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(_clean_rows(length, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def sql(length: int = LENGTH) -> str:
    """The same for DuckDB over the view documents, for doc_ids that are unique: every window at full length, in hex digits."""
    return f"""
with d as materialized (select row_number() over (order by doc_id nulls last, text) r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as materialized (select r, s, md5(substring(x, 2 * s + 1, {2 * length})) k from (select r, x, unnest(range(0, len(x) // 2 - {length - 1})) s from d where len(x) >= {2 * length})),
f as (select k, min((r, s)) least from w group by k having count(*) > 1),
again as materialized (select r, s from w join f using (k) where (r, s) <> least),
e as (select r, s, case when s <= lag(s) over (partition by r order by s) + {length} then 0 else 1 end new from again),
g as (select r, s, sum(new) over (partition by r order by s) run from e),
spans as materialized (select r, run, min(s) a, max(s) + {length} b from g group by r, run),
p as (select r, b, coalesce(lead(a) over (partition by r order by run), null) until from spans),
parts as (select r, -1 o, 0 a, min(a) b from spans group by r union all select r, b, b, until from p),
kept as (select d.r, coalesce(string_agg(substring(x, 2 * a + 1, 2 * coalesce(b, len(x) // 2) - 2 * a), '' order by o), '') y from parts join d using (r) group by d.r),
n as (select r, count(*) spans, sum(b - a) gone from spans group by r)
select d.doc_id, cast(len(x) // 2 as bigint) n_bytes, cast(coalesce(gone, 0) as bigint) n_removed, cast(coalesce(spans, 0) as bigint) n_spans, sha256(unhex(coalesce(y, x))) kept_sha256
from d left join kept using (r) left join n using (r)"""
