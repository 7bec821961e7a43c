"""State machines kept by a stream: runs, jobs, operations and locks, with event-time timers.

Steps (kind, id, seq, at, to_state) are folded by key with `transformWithState`. A step waits in its key's
state until the watermark has passed it and is then applied in the order of (at, seq), so any order of arrival within the
watermark's delay gives the same rows. A step that its machine doesn't allow changes nothing and goes to the side table. A state
that may be held for a limited time has a timer: it fires as the watermark, which all keys move together, passes the deadline, and needs no
further event of its key. A step at the deadline itself is in time.

State is one small row a key and what waits; a restart goes on from the checkpoint. Steps of unknown kinds, and ones that come later than the
delay allows, change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Machine:
    """Its first state, allowed steps, minutes that a state may be held, minutes for all states together, and the state that follows either limit."""

    first: str
    steps: dict[str, tuple[str, ...]]
    expired: str
    minutes: dict[str, int] = field(default_factory=dict)
    total: int | None = None

    def allows(self, state: str | None, to: str) -> bool:
        return to == self.first if state is None else to in self.steps.get(state, ())

    def deadline(self, state: str, started: int, since: int) -> int | None:
        """In milliseconds, as started (of the first state) and since (of this one) are; none for states that no limit holds for."""
        if state not in self.steps:
            return None
        ends = [since + 60_000 * self.minutes[state]] if state in self.minutes else []
        return min([*ends, *([started + 60_000 * self.total] if self.total else [])], default=None)


# States, allowed steps and limits. A step from a state to itself is a heartbeat, which renews its limit.
MACHINES = {
    "run": Machine(
        "initiated",
        {
            "initiated": ("discovering", "cancelled", "failed"),
            "discovering": ("matching", "completed", "failed", "timed_out", "cancelled"),
            "matching": ("executing", "failed", "timed_out", "cancelled"),
            "executing": ("completed", "partially_completed", "completed_with_ambiguity", "completed_with_warnings", "failed", "timed_out", "cancelled"),
        },
        "timed_out", {"discovering": 5, "matching": 10, "executing": 30}, 45,
    ),
    "job": Machine("QUEUED", {"QUEUED": ("CLAIMED", "CANCELLED"), "CLAIMED": ("CLAIMED", "RUNNING", "FAILED"), "RUNNING": ("RUNNING", "COMPLETED", "FAILED")}, "TIMED_OUT", {"CLAIMED": 5, "RUNNING": 5}),
    "operation": Machine("pending", {"pending": ("completed", "failed"), "failed": ("pending",)}, "failed", {"pending": 30}),
    "lock": Machine("held", {"held": ("released",), "released": ("held",), "expired": ("held",)}, "expired", {"held": 60}),
}

STEPS = "kind string, id long, seq long, at timestamp, to_state string"
ROWS = "kind string, id long, seq long, at timestamp, from_state string, to_state string, verdict string"


class Fold(StatefulProcessor):
    """Rows of a key as its steps are applied and its timers fire: verdict moved, illegal or expired (which has no seq)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, started long, since long, deadline long, timer long, waiting array<struct<at: long, seq: long, to_state: string>>")

    def _put(self, state, started, since, deadline, old, waiting) -> None:
        """One timer a key: for the first step that waits, or the deadline. old: the one that is set; each call is a round trip to the JVM, so they are few."""
        timer = min([w[0] for w in waiting] + ([] if deadline is None else [deadline]), default=None)
        if timer != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if timer is not None:
                self.handle.registerTimer(timer)
        self.now.update((state, started, since, deadline, timer, waiting))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802,N803  Spark's names
        if key[0] in MACHINES:
            *before, waiting = self.now.get() or (None, None, None, None, None, [])
            self._put(*before, [*map(tuple, waiting), *((r.ms, r.seq, r.to_state) for r in rows)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802,N803
        machine, passed = MACHINES[key[0]], timerValues.getCurrentWatermarkInMs()
        state, started, since, deadline, timer, waiting = self.now.get()
        waiting = [tuple(w) for w in waiting]
        due = sorted((w for w in waiting if w[0] <= passed), key=lambda w: w[:2])
        for at, seq, to in [*due, (passed + 1, None, None)]:
            if deadline is not None and deadline < at:
                yield Row(kind=key[0], id=key[1], seq=None, ms=deadline, from_state=state, to_state=machine.expired, verdict="expired")
                state, since = machine.expired, deadline
                deadline = machine.deadline(state, started, since)
            if to is None:
                break
            legal = machine.allows(state, to)
            yield Row(kind=key[0], id=key[1], seq=seq, ms=at, from_state=state, to_state=to, verdict="moved" if legal else "illegal")
            if legal:
                state, since, started = to, at, at if to == machine.first else started
                deadline = machine.deadline(state, started, since)
        self._put(state, started, since, deadline, timer if timer is not None and timer > passed else None, [w for w in waiting if w[0] > passed])

    def close(self) -> None:
        pass


def folded(steps: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The rows of a stream of steps. Times are milliseconds within the processor, so that no time zone of a worker matters."""
    keyed = steps.withWatermark("at", delay).withColumn("ms", F.unix_millis("at")).groupBy("kind", "id")
    rows = keyed.transformWithState(statefulProcessor=Fold(), outputStructType=ROWS.replace("at timestamp", "ms long"), outputMode="Append", timeMode="EventTime")
    return rows.select("kind", "id", "seq", F.timestamp_millis("ms").alias("at"), "from_state", "to_state", "verdict")


def started(steps: DataFrame, folder: str, delay: str = "1 hour") -> StreamingQuery:
    """Starts the fold over what is there now; rows go to folder/steps, a partition for each verdict, so that illegal steps are a side table of their own."""
    spark = steps.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)  # the store that keeps lists and timers; a query takes the setting as it starts
    try:
        return (
            folded(steps, delay).writeStream.format("parquet").partitionBy("verdict").option("path", f"{folder}/steps")
            .option("checkpointLocation", f"{folder}/machines").outputMode("append").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{folder}/steps")


def latest(rows: DataFrame) -> DataFrame:
    """The state of each key: that of its last row that isn't illegal."""
    last = F.max(F.struct("at", F.coalesce("seq", F.lit(-1)), "to_state", "verdict"))
    return rows.where("verdict <> 'illegal'").groupBy("kind", "id").agg(last.alias("_l")).select("kind", "id", F.col("_l.to_state").alias("state"), (F.col("_l.verdict") == "expired").alias("by_timer"))


def sql(steps: str) -> str:
    """The same fold in DuckDB over the relation `steps`, with all timers fired: a recursion over each key's steps in order."""
    text = lambda pairs: ", ".join(f"'{k}': {v}" for k, v in pairs)
    allowed = ", ".join([f"'{k}:>{m.first}'" for k, m in MACHINES.items()] + [f"'{k}:{a}>{b}'" for k, m in MACHINES.items() for a, to in m.steps.items() for b in to])
    minutes = text((f"{k}:{s}", n) for k, m in MACHINES.items() for s, n in m.minutes.items())
    totals = text((f"{k}:{s}", m.total) for k, m in MACHINES.items() if m.total for s in m.steps)
    expired = text((k, f"'{m.expired}'") for k, m in MACHINES.items())
    first = text((k, f"'{m.first}'") for k, m in MACHINES.items())
    limit = f"least(since + interval 1 minute * map {{{minutes}}}[kind || ':' || state], started + interval 1 minute * map {{{totals}}}[kind || ':' || state])"
    return f"""n as (select *, row_number() over (partition by kind, id order by "at", seq) n from {steps}),
f as (select kind, id, 0::bigint n, null::bigint seq, null::timestamp "at", null::varchar was, null::varchar expired_to, null::timestamp expired_at, null::varchar to_state, false legal, null::varchar state, null::timestamp started, null::timestamp since, null::timestamp deadline from n where n = 1
  union all select kind, id, n, seq, "at", was, expired_to, expired_at, to_state, legal, state, started, since, {limit} from (
    select *, case when legal then to_state else was_now end state, case when legal and to_state = map {{{first}}}[kind] then "at" else started_before end started, case when legal then "at" when expired_at is not null then expired_at else since_before end since from (
      select *, coalesce(list_contains([{allowed}], kind || ':' || coalesce(was_now, '') || '>' || to_state), false) legal from (
        select n.kind, n.id, n.n, n.seq, n."at", n.to_state, f.state was, case when f.deadline < n."at" then map {{{expired}}}[n.kind] end expired_to, case when f.deadline < n."at" then f.deadline end expired_at,
          case when f.deadline < n."at" then map {{{expired}}}[n.kind] else f.state end was_now, f.started started_before, f.since since_before from f join n on n.kind = f.kind and n.id = f.id and n.n = f.n + 1)))),
folded as (select kind, id, seq, "at", coalesce(expired_to, was) from_state, to_state, case when legal then 'moved' else 'illegal' end verdict from f where n > 0
  union all select kind, id, null, expired_at, was, expired_to, 'expired' from f where expired_at is not null
  union all select kind, id, null, deadline, state, map {{{expired}}}[kind], 'expired' from f where deadline is not null qualify row_number() over (partition by kind, id order by n desc) = 1 and n = (select max(n) from n m where m.kind = f.kind and m.id = f.id))"""
