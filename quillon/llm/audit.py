"""Filter interaction audit: what each filter removes in every order, by permutation-trie execution.

The orders of the filters form a trie; a node is a prefix of filters and what survives it depends on the prefix's set
alone. `execute` walks the trie depth-first: a state, the set of filters applied so far, is its parent's
survivors with one more filter applied, a persisted DataFrame that its children read; a state met again by another order
is taken from memory (n! orders of n filters need 2^n states). At every state one aggregate by part counts
what each filter still to come removes from the survivors: one count for every edge of the trie. States are
dropped on the way back, so at most n are kept at a time.

Documents are judged once, with JVM expressions, into a table of verdicts without texts; removals happen on its
rows, document by document. Filter E needs the smallest doc_id of each text: rows that hold it are found by a join on
(doc_id, hash of the text), so the copies of a frequent text aren't gathered.

Defined results: a null text is empty; of rows with a null doc_id none is smaller than another, so E fails them only
where a doc_id has their text; rows that share doc_id and text don't fail E by each other; a doc_id with several labels is good or toxic if one of them
says so, and without a label neither; a null source is the part of the empty string; texts of any length are judged whole, in a
task each; an empty table has no parts and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import dropped, words, written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2

# Characters that no document may hold.
SYMBOLS = "[#$%&*|]"


def _own(text: Column) -> Column:
    """Struct of the verdicts of A to D: whether each fails the text."""
    def of(w: Column) -> Column:
        n = F.size(w)
        capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        return F.struct(
            (n < LEAST_WORDS).alias("A"),
            (100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * n).alias("B"),
            (100 * capitals > CAPITAL_PERCENT * F.length(text)).alias("C"),
            text.rlike(SYMBOLS).alias("D"),
        )

    return F.transform(F.array(words(text)), of)[0]  # the words are cut once


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text, source): part, A to E (true: the filter fails it), good, toxic."""
    text = F.coalesce("text", F.lit(""))
    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), _own(text).alias("_v"))
    judged = written(judged.select("doc_id", "part", "h", "_v.*"), "judged")
    first = written(judged.groupBy("h").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("h", "doc_id", F.lit(True).alias("first")), "first")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    ided = judged.where("doc_id is not null").join(first, ["doc_id", "h"], "left").join(marks, "doc_id", "left").withColumn("E", F.col("first").isNull())
    # Rows without a doc_id have no key of their own: they ask by text. A join, but no copies of a text with doc_ids take part.
    none = judged.where("doc_id is null").join(first.select("h", "first"), "h", "left").select("*", F.lit(None).cast("boolean").alias("good"), F.lit(None).cast("boolean").alias("toxic"), F.col("first").isNotNull().alias("E"))
    names = ["part", *FILTERS, "good", "toxic"]
    both = [df.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]) for df in (ided, none)]
    out = written(both[0].unionByName(both[1]).select(*names), "verdicts")
    dropped(judged)
    dropped(first)
    return out


def mask(filters) -> int:
    """The state of a set of filters as bits."""
    return sum(1 << FILTERS.index(f) for f in filters)


def execute(table: DataFrame) -> dict[int, DataFrame]:
    """For each state of the trie its counts by part: part, n (survivors), and for each filter to come removed_F, good_F, toxic_F."""
    counted: dict[int, DataFrame] = {}

    def visit(prefix: str, survivors: DataFrame) -> None:
        state = mask(prefix)
        if state in counted:  # another order of the same filters came here before
            return
        survivors = survivors.persist()
        each = [F.count(F.lit(1)).alias("n")]
        for f in FILTERS:
            if f not in prefix:
                each += [F.count_if(F.col(f)).alias(f"removed_{f}"), F.count_if(F.col(f) & F.col("good")).alias(f"good_{f}"), F.count_if(F.col(f) & F.col("toxic")).alias(f"toxic_{f}")]
        counted[state] = written(survivors.groupBy("part").agg(*each), "edges")
        for f in FILTERS:
            if f not in prefix:
                visit(prefix + f, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit("", table)
    return counted


def _long(state: int, counts: DataFrame) -> DataFrame:
    """A state's counts as one struct, alike for all states: arrays in the order of FILTERS."""
    edges = [f"array({', '.join(f'{c}_{f}' if f'{c}_{f}' in counts.columns else '0L' for f in FILTERS)}) {c}" for c in ("removed", "good", "toxic")]
    return counts.selectExpr("part", f"{state} state", f"struct(n, {', '.join(edges)}) at")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    table = verdicts(docs, labels)
    counted = execute(table)
    states = reduce(DataFrame.union, [_long(s, c) for s, c in counted.items()]).groupBy("part").agg(F.expr("map_from_entries(collect_list(struct(state, at))) states"))  # at most 2^5 entries a part
    failed = " + ".join(f"int({f})" for f in FILTERS)
    alone = table.groupBy("part").agg(F.expr(f"array({', '.join(f'count_if({f} and {failed} = 1)' for f in FILTERS)})").alias("alone"))
    of_part = written(states.join(alone, "part"), "parts")
    for counts in counted.values():
        dropped(counts)
    dropped(table)

    weights = [math.factorial(k) * math.factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]  # orders in which a filter comes after just these k
    others = "filter(map_entries(states), e -> (e.key & shiftleft(1, s.f)) = 0)"
    shapley = f"aggregate({others}, 0L, (sum, e) -> sum + e.value.removed[s.f] * array({', '.join(map(str, weights))})[bit_count(e.key)])"
    steps = [{"filter_order": "".join(order), "step": k + 1, "state": mask(order[:k]), "f": FILTERS.index(order[k])} for order in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    known = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,state:int,f:int>>")
    long = of_part.select("*", F.explode(known).alias("s")).selectExpr("*", "states[s.state] at")
    got = lambda c: f"coalesce(at.{c}[s.f], 0L)"  # noqa: E731  a part without survivors has no row in a state
    return long.selectExpr(
        "part", "s.filter_order", "s.step", f"coalesce(at.n, 0L) - {got('removed')} kept", f"{got('removed')} removed", f"states[0].removed[s.f] - {got('removed')} redundant",
        "alone[s.f] unique_fails", f"{got('good')} good_lost", f"{got('toxic')} toxic_lost", f"{shapley} shapley",
    )


def sql() -> str:
    """The same for DuckDB over the views documents and labels: every order judged from the kinds of documents."""
    orders = ", ".join(f"('{''.join(p)}')" for p in itertools.permutations(FILTERS))
    return f"""
with d as materialized (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w from documents),
m as (select t, min(doc_id) least from d group by t),
l as (select doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic from labels group by doc_id),
v as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
  (case when len(w) < {LEAST_WORDS} then 'A' else '' end) || (case when 100 * len(list_distinct(w)) < {DISTINCT_PERCENT} * len(w) then 'B' else '' end)
  || (case when 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * len(t) then 'C' else '' end) || (case when regexp_matches(t, '{SYMBOLS}') then 'D' else '' end)
  || (case when least is not null and (doc_id is null or doc_id > least) then 'E' else '' end) fails
  from d join m using (t) left join l using (doc_id)),
k as materialized (select part, good, toxic, fails, count(*) n from v group by all),
o as (select f filter_order, unnest(range(1, {len(FILTERS) + 1})) step from (values {orders}) x(f)),
p as (select filter_order, step, filter_order[1:step - 1] earlier, filter_order[step] f from o),
c as (select part, filter_order, step, f,
  sum(n) filter (translate(fails, earlier || f, '') = fails) kept,
  sum(n) filter (contains(fails, f) and translate(fails, earlier, '') = fails) removed,
  sum(n) filter (contains(fails, f) and translate(fails, earlier, '') <> fails) redundant,
  sum(n) filter (fails = f) unique_fails,
  sum(n) filter (good and contains(fails, f) and translate(fails, earlier, '') = fails) good_lost,
  sum(n) filter (toxic and contains(fails, f) and translate(fails, earlier, '') = fails) toxic_lost
  from k, p group by all)
select part, filter_order, cast(step as int) step, {", ".join(f"cast(coalesce({x}, 0) as bigint) {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  cast(coalesce(sum(removed) over (partition by part, f), 0) as bigint) shapley from c"""
