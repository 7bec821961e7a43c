"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents of equal text are linked. A clique of links is kept as a star, a group with the number of its
members in each shard, so an iteration costs rows of groups, never pairs. Shards hold equal numbers of rows: with
N rows and S shards every shard has a quota of N // S, and the first N % S one more (law `rows`).

1. Every row starts in the shard that its rank in hash order gives, so the counts are right from the start.
2. Groups as large as a shard, fewer than S of them, fill whole shards; what is left of one is a group like others.
3. In each iteration an open group votes for the shard that most of its members are in, of those with room for
   all of it (of equal counts by a hash that changes with the iteration; of all shards if none of its own has room).
   The groups that want a shard enter it whole in the order of their size, as far as the room goes. The first in
   each order always fits, so it ends, when nothing is open or no room holds any group that is.
4. Groups that no room holds whole are laid one after another into the rooms left, which splits few of them.
5. Unlinked rows fill the quotas exactly, most of them where they were.

The driver knows S loads and the sizes of fewer than S large groups. Every cut is by a gapless rank or a running
sum over rows dealt by range. Only DataFrame operations are used.

Defined results: a null text has size 8, crc32 0 and no links; empty texts are equal texts; repeated rows are
linked like other copies; a null doc_id is dealt like any other; ties go by hash, then row number; texts of any
length count as one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import dropped, ranked, written

#: Tables of groups that entered, one an iteration, up to which they stand apart.
APART = 16


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, size, text_crc32, law (`rows`), shard, slot (gapless from 0 within the shard), grown_shard (null under this law), n_copies (rows of this text) and n_with (those of them in this shard)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("g1"), F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text")).alias("g2"))
    # Repeated rows are told apart by their rank, which also deals the first shards.
    mixed = rows.withColumn("mix", F.xxhash64("doc_id", "g1")).withColumn("tie", F.monotonically_increasing_id())
    dealt = ranked(mixed, [], ["mix", "tie"], "id").drop("mix", "tie").withColumn("shard", (F.col("id") % shards).cast("int"))
    groups = dealt.where("g1 is not null").groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = written(groups, "groups")  # a table of its own, so that a hot group is split in the join
    state = written(dealt.join(groups, ["g1", "g2"], "left").withColumn("members", F.coalesce("members", F.lit(1))), "shards")
    total = state.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    linked = state.where("members > 1")

    least = max(1, quotas[-1])
    large = groups.where(F.col("members") >= least).orderBy(F.desc("members"), "g1", "g2").collect()  # fewer than two for each shard
    room, laid = _large_groups([r["members"] for r in large], quotas)
    votes = linked.where(F.col("members") < least).groupBy("g1", "g2", "members", "shard").agg(F.count(F.lit(1)).alias("n"))
    open_ = written(votes.groupBy("g1", "g2", "members").agg(F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("votes")), "votes")
    homes = []
    for i in itertools.count():  # until no group finds room; each iteration places the largest group of every shard asked at least
        entered = _entered(open_, room, i)
        loads = {r["shard"]: r["load"] for r in entered.groupBy("shard").agg(F.sum("members").alias("load")).collect()}
        if not loads:
            break
        room = [x - loads.get(s, 0) for s, x in enumerate(room)]
        homes.append(entered)
        if len(homes) > APART:
            together = written(reduce(DataFrame.union, homes), "entered")
            for table in homes:
                dropped(table)
            homes = [together]
        rest = written(open_.join(entered.select("g1", "g2"), ["g1", "g2"], "left_anti"), "votes")
        dropped(open_)
        open_ = rest
    at_home = open_.select("g1", "g2", F.lit(None).cast("int").alias("home"))
    for entered in homes:
        at_home = at_home.union(entered.select("g1", "g2", F.col("shard").alias("home")))
    at_home = written(at_home, "homes")
    for table in (open_, *homes):
        dropped(table)

    # Rows of a large group, and of groups that no room held, are laid in order into stretches of given length.
    whole = linked.join(at_home, ["g1", "g2"], "left").select("id", "g1", "g2", "members", "home")
    placed = whole.where("home is not null").select("id", F.col("home").alias("shard"))
    rest = whole.where("home is null").withColumn("order", -F.col("members"))
    lengths = laid + [(s, room[s]) for s in sorted(range(shards), key=lambda s: -room[s])]
    in_order = ranked(rest.select("id", "g1", "g2", "order"), [], ["order", "g1", "g2", "id"], "turn")
    placed = placed.union(in_order.select("id", _stretch(F.col("turn"), lengths).alias("shard")))

    # In each shard linked rows come first, then the others; what is over the quota takes the places left elsewhere.
    both = placed.withColumn("order", F.lit(0)).union(state.where("members = 1").select("id", "shard", F.lit(1)))
    settled = written(ranked(both, ["shard"], ["order", "id"], "slot").withColumn("over", F.col("slot") >= _at(quotas, F.col("shard"))).drop("order"), "settled")
    taken = {r["shard"]: r["n"] for r in settled.where("not over").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    free = [(s, q - taken.get(s, 0)) for s, q in enumerate(quotas)]
    starts = [sum(n for _, n in free[:s]) for s in range(shards)]
    homeless = ranked(settled.where("over").select("id"), [], ["id"], "turn").withColumn("shard", _stretch(F.col("turn"), free))
    moved = homeless.select("id", "shard", (F.col("turn") - _at(starts, F.col("shard")) + _at([taken.get(s, 0) for s in range(shards)], F.col("shard"))).alias("slot"))
    seats = settled.where("not over").select("id", "shard", "slot").union(moved)
    out = written(state.drop("shard").join(seats, "id"), "placed")
    for table in (state, settled, at_home):
        dropped(table)
    with_ = out.where("members > 1").groupBy("g1", "g2", "shard").agg(F.count(F.lit(1)).alias("n_with"))
    return out.join(with_, ["g1", "g2", "shard"], "left").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("members").alias("n_copies"), F.coalesce("n_with", F.lit(1)).alias("n_with"))


def _large_groups(sizes: list[int], quotas: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """For groups as large as a shard, largest first: the room left in each shard, and stretches (shard, rows) in which their rows lie one after another."""
    room, laid = list(quotas), []
    for left in sizes:
        while left:
            fits = [s for s, x in enumerate(room) if x >= left]
            # The rest goes where it fits closest; before that the emptiest shard is filled.
            s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
            laid.append((s, min(left, room[s])))
            left -= laid[-1][1]
            room[s] -= laid[-1][1]
    return room, laid


def _entered(open_: DataFrame, room: list[int], iteration: int) -> DataFrame:
    """Of open groups (g1, g2, members, votes) those that enter a shard now: g1, g2, members, shard."""
    fits = [(F.lit(x) >= F.col("members")) for x in room]
    of = lambda s, n: F.struct(n.alias("n"), F.xxhash64("g1", F.lit(s), F.lit(iteration)).alias("h"), F.lit(s).alias("shard"))
    best = F.array_max(F.array_compact(F.array(*[F.when(fit, of(s, F.coalesce(F.col("votes")[s], F.lit(0)).cast("long"))) for s, fit in enumerate(fits)])))
    wishes = open_.select("g1", "g2", "members", best["shard"].alias("shard"), (-F.col("members")).alias("order")).where("shard is not null")
    queue = ranked(wishes, ["shard"], ["order", "g1", "g2"], "before", weight="members")
    return written(queue.where(F.col("before") + F.col("members") <= _at(room, F.col("shard"))).select("g1", "g2", "members", "shard"), "entered")


def _stretch(turn: Column, lengths: list[tuple[int, int]]) -> Column:
    """The shard of the stretch (shard, rows) that a place in their order falls in."""
    out, end = F.lit(None).cast("int"), sum(n for _, n in lengths)
    for s, n in reversed(lengths):
        if n:
            out = F.when(turn < end, s).otherwise(out)
        end -= n
    return out


def _at(values: list[int], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), place + 1)
