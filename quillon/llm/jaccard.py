"""N-gram Jaccard join by vertical partitioning, returning the components that its links form.

1. Each text becomes a set of 64-bit shingle hashes. Equal sets form a class, represented by one row.
2. Sieve: in hash order, two sets that link share `need` of their first `need + p - 1` shingles, p being the
   usual prefix length and need one less, but 1 at least. Classes that share fewer with all others together can't link; only the others go on.
3. Their shingles are put in one global order, rarest first. Those of one class alone stay at the front, as
   a number. The order is cut into fragments of about equal mass, so a set becomes one segment a fragment.
4. Candidates share a shingle within both prefixes, at positions that leave the overlap in reach. The overlap
   of a pair is counted in each fragment separately and summed.
5. Groups of near copies would make all pairs. So each prefix shingle first pairs its sets with one leader; then
   only pairs of different components so far are joined, the largest component of each shingle on one side
   only. Every pair left out lies within a component already, so components are exact.

Defined results: a text with fewer words than a shingle is one shingle; a text without words, or null, has an
empty set and is a component of its own; repeated rows each give a row; a row with a null doc_id takes part,
and other rows may be linked through it, but no component is named after it (one of such rows alone has a null
component_id); texts that share a doc_id are judged each for itself; ties go to the smallest doc_id; texts of any
length are taken whole, in one task each with some 20 bytes of memory a byte of text; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.graph import components
from quillon.llm.shared import Words, dropped, mix, signed, slices, whole_row, written

FRAGMENTS = 8


def shingle_sets(texts: pa.Array, n: int):
    """For runs of rows (first, last): the offsets of their sets in an array of distinct sorted shingle hashes."""
    for a, b, data, bounds in slices(texts):
        w = Words(data, bounds, lower=True)
        count = np.diff(w.first)
        grams, doc = w.grams(n), np.repeat(np.arange(b - a), count)
        whole = w.whole(n)
        grams, doc = grams[whole], doc[: len(whole)][whole]
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            one = np.zeros(len(short), dtype=np.uint64)
            for j in range(n - 1):
                has = count[short] > j
                one[has] = mix(one[has] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.first[short[has]] + j])
            grams, doc = np.concatenate([grams, mix(one + np.uint64(7))]), np.concatenate([doc, short])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        fresh = np.ones(len(grams), dtype=bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        grams, doc = grams[fresh], doc[fresh]
        yield a, b, np.searchsorted(doc, np.arange(b - a + 1)), grams


def prefix_lengths(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of these sizes, how many of the first shingles to look at, and how many of them a partner of any size shares at least.

    Sets of sizes a and b with overlap o share need_a + o - ceil(t * a) of them or need_b + o - ceil(t * b), whichever is
    less, so that neither need may be over these. Above 62 percent p - 1 never is (tests try all sizes up to 700; beyond,
    the room grows with the size); p itself is for small sets, as a smaller partner may show fewer.
    """
    p = size - -(-percent * size // 100) + 1
    need = np.maximum(1, p - 1) if percent > 62 else np.ones_like(p)
    return np.minimum(size, p + need - 1), need


def _keys(at: np.ndarray, grams: np.ndarray) -> list[np.ndarray]:
    """Two sums that name a set: equal sets have equal sums."""
    keys = []
    for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams + salt))])
        keys.append(signed(sums[at[1:]] - sums[at[:-1]]))
    return keys


def _sieve_rows(n: int, percent: int):
    def scan(batches):
        for batch in batches:
            for a, b, at, grams in shingle_sets(batch.column(3), n):
                size = np.diff(at)
                k, need = prefix_lengths(size, percent)
                k = np.where(size > 0, k, 0)
                ends = np.concatenate([[0], np.cumsum(k)])
                take = np.repeat(at[:-1] - ends[:-1], k) + np.arange(ends[-1])
                front = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(grams[take])))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in range(3)), pa.array(size, pa.int64()), *map(pa.array, _keys(at, grams)), pa.array(need, pa.int64()), front], names=["doc_id", "h1", "h2", "n", "k1", "k2", "need", "front"])

    return scan


def _set_rows(n: int):
    def scan(batches):
        for batch in batches:
            for _, _, at, grams in shingle_sets(batch.column(0), n):
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(at), pa.int64()), *map(pa.array, _keys(at, grams)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(signed(grams)))], names=["n", "k1", "k2", "toks"])

    return scan


def _least_overlap(percent: int, a: Column, b: Column) -> Column:
    """The least overlap of sets of sizes a and b whose union is at most 100 / percent times as large."""
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _verified(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b, na, nb) that link, as (u, v): overlaps are counted fragment by fragment and summed."""
    pairs = written(pairs, "pairs")
    involved = written(segments.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep"), "segments")
    left = involved.select(F.col("rep").alias("a"), "frag", F.col("toks").alias("ta"))
    right = involved.select(F.col("rep").alias("b"), "frag", F.col("toks").alias("tb"))
    parts = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
    sums = parts.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    links = written(sums.where(F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
    dropped(pairs)
    dropped(involved)
    return links


def join(docs: DataFrame, n: int = 5, percent: int = 80, fragments: int = FRAGMENTS) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard similarity of percent / 100 or more, itself included)."""
    return _grouped(docs, n, percent, fragments).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _text_keys() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")


def _grouped(docs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """One row per row of docs: doc_id, h1 and h2 (which name its text), n, component_id, and `group`, which names its component (null without words)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), "text")
    sieve = written(texts.mapInArrow(_sieve_rows(n, percent), "doc_id long, h1 long, h2 long, n long, k1 long, k2 long, need long, front array<long>"), "sieve")
    rows = written(sieve.select("doc_id", "h1", "h2", "n", "k1", "k2"), "rows")
    names, found = _components(texts, sieve, n, percent, fragments)
    near = written(names.join(found.withColumnRenamed("node", "rep"), "rep").groupBy("k1", "k2").agg(F.min("component").alias("component")), "near")
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"))
    # The smallest doc_id is looked for at the end, so that rows without one, or several texts of one, can still be links in a chain.
    together = classes.join(near, ["k1", "k2"]).groupBy("component").agg(F.min("least").alias("_least"), F.min(F.struct("k1", "k2")).alias("_group"))
    named = classes.join(near.join(together, "component"), ["k1", "k2"], "left").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("_least", "least").alias("_component"), F.coalesce("_group", F.struct("k1", "k2")).alias("group"))
    named = written(named, "named")  # a table of its own, so that a hot class is split in the join
    for table in (names, near):
        dropped(table)
    out = rows.join(named, (rows.k1 == named._k1) & (rows.k2 == named._k2) & (rows.n > 0), "left")
    return out.select("doc_id", "h1", "h2", "n", F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id (null comes last; of texts of one doc_id that of the lowest hash); of repeated rows one stays. Texts without words all stay."""
    grouped = written(_grouped(docs, n, percent, FRAGMENTS), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "h1", "h2")).alias("_r")
    one = grouped.where("n > 0").groupBy("group").agg(first).select("_r.doc_id", "_r.h1", "_r.h2")
    stay = one.union(grouped.where("n = 0").select("doc_id", "h1", "h2").distinct())
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("_d"), c.isNull().alias("_null")]
    stay = stay.select(*key(F.col("doc_id")), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    h1, h2 = _text_keys()
    keys = ["_d", "_null", "_h1", "_h2"]
    keyed = docs.select(whole_row(docs).alias("row"), *key(F.col("doc_id").cast("long")), h1.alias("_h1"), h2.alias("_h2"))
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select("row.*")


def _components(texts: DataFrame, sieve: DataFrame, n: int, percent: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """The classes that may link (rep, k1, k2), and their components (node, component) in terms of rep."""
    # One row a class: equal sets have equal fronts. The copies of a hot text fall away before the shuffle.
    fronts = sieve.where("n > 0").groupBy("k1", "k2").agg(F.first("need").alias("need"), F.first("front").alias("front"), F.min(F.struct("h1", "h2")).alias("h"))
    fronts = written(fronts.select("k1", "k2", "need", "front", "h.h1", "h.h2"), "fronts")
    dropped(sieve)
    # Here k1 stands for the class: if two classes had it in common, both would only pass more easily.
    posted = fronts.select("k1", F.explode("front").alias("tok"))
    common = posted.groupBy("tok").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("tok")
    common = written(common, "common")  # a table of its own, so that both sides are dealt for the join and a hot shingle can be split
    passed = posted.join(common.hint("shuffle_hash"), "tok").groupBy("k1").agg(F.count(F.lit(1)).alias("_c"))
    through = written(fronts.select("h1", "h2", "k1", "need").join(passed, "k1").where("_c >= need").select("h1", "h2"), "through")
    dropped(fronts)
    dropped(common)

    distinct = texts.select("h1", "h2", "text").where("text is not null").dropDuplicates(["h1", "h2"])
    chosen = distinct.join(through, ["h1", "h2"], "left_semi").select("text")
    sets = chosen.mapInArrow(_set_rows(n), "n long, k1 long, k2 long, toks array<long>")
    whole = written(sets.withColumn("rep", F.monotonically_increasing_id()), "whole")  # written, so the numbers stay
    dropped(through)
    names = written(whole.select("rep", "k1", "k2"), "names")
    links = _links(whole, percent, fragments)
    found = components(links[0].union(links[1]))
    for table in links:
        dropped(table)
    return names, found


def _links(whole: DataFrame, percent: int, fragments: int) -> tuple[DataFrame, DataFrame]:
    """Of sets (rep, n, toks), which are dropped: two tables of links (u, v) that together give the same components as all links."""
    tokens = whole.select("rep", F.explode("toks").alias("tok"))
    df = written(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "df")
    # In the global order rarer shingles come first, then lower hashes.
    shared = written(tokens.join(df.hint("shuffle_hash"), "tok").select("rep", F.col("df").cast("int").alias("df"), "tok"), "shared")
    dropped(df)
    ordered = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
    alone = F.col("n") - F.size("toks")  # shingles of this set alone, which come first
    front = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    sets = written(ordered.join(whole.select("rep", "n"), "rep").where(front > alone), "sets")
    dropped(whole)
    dropped(shared)
    place = lambda t: F.least(t["df"], F.lit(1 << 20)) + F.shiftrightunsigned(t["tok"], 1) / F.lit(2.0**63)
    cuts = sorted(set(sets.select(F.explode("toks").alias("t")).agg(F.percentile_approx(place(F.col("t")), [i / fragments for i in range(1, fragments)], 1000).alias("c")).first()["c"] or []))
    bounds = [float("-inf"), *cuts, float("inf")]
    cut = lambda lo, hi: F.transform(F.filter("toks", lambda t: (place(t) > lo) & (place(t) <= hi)), lambda t: t["tok"])
    segments = sets.select("rep", F.posexplode(F.array(*[cut(lo, hi) for lo, hi in zip(bounds, bounds[1:])])).alias("frag", "toks")).where(F.size("toks") > 0)
    prefix = F.slice("toks", 1, F.greatest(F.lit(0), front - F.col("alone")).cast("int"))
    posted = written(sets.withColumn("alone", alone).where(front > alone).select("rep", "n", "alone", F.posexplode(prefix).alias("i", "t")).select("rep", "n", "alone", F.col("t.tok").alias("tok"), (F.col("alone") + F.col("i") + 1).alias("pos")), "prefixes")

    # Leaders: for each prefix shingle and band of sizes, the set with the fewest shingles of its own.
    band = lambda shift: F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(shift))
    lead, leaders = None, []
    for shift in (0.0, 0.5):
        banded = posted.withColumn("band", band(shift))
        best = banded.groupBy("tok", "band").agg(F.min(F.struct("alone", "rep", "n")).alias("l"), F.count(F.lit(1)).alias("_c")).where("_c > 1").select("tok", "band", F.col("l.rep").alias("b"), F.col("l.n").alias("nb"))
        best = written(best, "leaders")  # again a table of its own, for the sake of hot shingles
        leaders.append(best)
        pairs = banded.join(best, ["tok", "band"]).where("rep <> b").select(F.col("rep").alias("a"), "b", F.col("n").alias("na"), "nb")
        lead = pairs if lead is None else lead.union(pairs)
    lead = lead.where(_in_reach(percent)).distinct()
    first = _verified(lead, segments, percent)
    known = written(components(first), "known")

    placed = posted.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component", "alone")
    placed = written(placed, "placed")
    per = placed.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("_c"))
    top = per.groupBy("tok").agg(F.max(F.struct("_c", "comp")).alias("m"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("tok", F.col("m.comp").alias("top"))
    top = written(top, "top")
    open_ = placed.join(top, "tok")
    small = open_.where("comp <> top").select("tok", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
    every = open_.select("tok", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), (F.col("comp") == F.col("top")).alias("_top"))
    o = _least_overlap(percent, F.col("na"), F.col("nb"))
    rest = small.join(every, "tok").where((F.col("ca") != F.col("cb")) & (F.col("_top") | (F.col("a") < F.col("b"))) & _in_reach(percent) & (F.col("pa") <= F.col("na") - o + 1) & (F.col("pb") <= F.col("nb") - o + 1))
    second = _verified(rest.select("a", "b", "na", "nb").distinct(), segments, percent)
    for table in (posted, placed, sets, known, top, *leaders):
        dropped(table)
    return first, second


def _in_reach(percent: int) -> Column:
    """Whether the sizes na and nb alone allow a link."""
    return F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")


def sql(n: int, percent: int) -> str:
    """The same for DuckDB over the view documents: all pairs that share a shingle, then reachability."""
    return f"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as materialized (select doc_id, list_distinct(case when coalesce(len(w), 0) = 0 then []::varchar[] when len(w) < {n} then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) end) s from w),
e as materialized (select doc_id, len(s) n, unnest(s) g from s),
p as materialized (select a.doc_id a, b.doc_id b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
l as materialized (select a, b from p union all select b, a from p),
reach(doc_id, r) as (select doc_id, doc_id from s union select l.b, reach.r from reach join l on l.a = reach.doc_id)
select s.doc_id, cast(len(s.s) as bigint) n_shingles, c.component_id from s join (select doc_id, min(r) component_id from reach group by doc_id) c using (doc_id)"""
