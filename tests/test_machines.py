"""State machines of a stream against a plain loop: restart, disorder, timers without further steps."""

import datetime
import random

from quillon.plans import streams
from quillon.streaming import machines as M

START = datetime.datetime(2024, 5, 1)
MINUTE = datetime.timedelta(minutes=1)


def loop(steps, clock):
    """Each key's steps one after another, then what its limits end by `clock`."""
    out = []
    for key in sorted({s[:2] for s in steps}):
        m, state, started, since = M.MACHINES[key[0]], None, None, None

        def limit():
            if state not in m.steps:
                return None
            ends = [since + m.minutes[state] * MINUTE] if state in m.minutes else []
            return min(ends + ([started + m.total * MINUTE] if m.total else []), default=None)

        for _, _, seq, at, to in [*sorted((s for s in steps if s[:2] == key), key=lambda s: (s[3], s[2])), (*key, None, clock, None)]:
            if limit() is not None and limit() < at:
                out.append((*key, None, limit(), state, m.expired, "expired"))
                state, since = m.expired, limit()
            if to is None:
                break
            ok = to == m.first if state is None else to in m.steps.get(state, ())
            out.append((*key, seq, at, state, to, "moved" if ok else "illegal"))
            if ok:
                started = at if to == m.first else started
                state, since = to, at
    return sorted(out, key=str)


def run(spark, folder):
    stream = spark.readStream.schema(M.STEPS).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = M.started(stream, folder)
    query.awaitTermination()
    return query


def put(spark, folder, rows):
    spark.createDataFrame(rows, M.STEPS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def got(spark, folder):
    return sorted((tuple(r) for r in M.results(spark, folder).collect()), key=str)


def tick(at):
    return ("clock", -1, -1, at, "tick")


def made(seed, keys=12, steps=9):
    r = random.Random(seed)
    out = []
    for k in range(keys):
        kind = r.choice(sorted(M.MACHINES))
        states = sorted({M.MACHINES[kind].first, *(t for v in M.MACHINES[kind].steps.values() for t in v)})
        at = START + r.randrange(60) * MINUTE
        for i in range(steps):
            out.append((kind, k, 100 * k + i, at, M.MACHINES[kind].first if i == 0 else r.choice(states)))
            at += r.choice([0, 1, 2, 4, 5, 6, 12, 31]) * MINUTE
    return out


def test_rows_are_the_loops_through_a_restart_and_disorder(spark, tmp_path):
    folder, steps = str(tmp_path), made(1)
    r = random.Random(2)
    order = sorted(steps, key=lambda s: s[3] + r.randrange(40) * MINUTE)  # out of turn by less than the delay
    cut = len(order) // 2
    for part in (order[: cut // 2], order[cut // 2 : cut]):
        put(spark, folder, part)
    run(spark, folder)
    first = got(spark, folder)
    assert 0 < len(first)
    run(spark, folder)  # a restart with nothing new changes nothing
    assert got(spark, folder) == first
    clock = max(s[3] for s in steps) + datetime.timedelta(days=1)
    for part in (order[cut:], [tick(clock)]):
        put(spark, folder, part)
    run(spark, folder)
    want = loop(steps, clock)
    assert got(spark, folder) == want
    assert {w[6] for w in want} == {"moved", "illegal", "expired"}
    side = spark.read.parquet(f"{folder}/steps/verdict=illegal")
    assert side.count() == sum(w[6] == "illegal" for w in want)
    last = {(x.kind, x.id): (x.state, x.by_timer) for x in M.latest(M.results(spark, folder)).collect()}
    assert all(last[w[:2]] == (w[5], True) for w in want if w[6] == "expired" and not any(v[:2] == w[:2] and v[3] > w[3] and v[6] != "illegal" for v in want))


def test_timers_fire_without_a_step_and_steps_at_the_deadline_are_in_time(spark, tmp_path):
    folder = str(tmp_path)
    steps = [
        ("operation", 1, 1, START, "pending"), ("operation", 2, 2, START, "pending"), ("operation", 2, 3, START + 30 * MINUTE, "completed"),
        ("job", 3, 4, START, "QUEUED"), ("job", 3, 5, START, "CLAIMED"), ("job", 3, 6, START + 5 * MINUTE, "RUNNING"), ("job", 3, 7, START + 10 * MINUTE, "RUNNING"), ("job", 3, 8, START + 16 * MINUTE, "COMPLETED"),
        ("lock", 4, 9, START, "held"), ("run", 5, 10, START, "initiated"), ("unknown", 6, 11, START, "x"),
    ]
    put(spark, folder, steps)
    put(spark, folder, [tick(START + 200 * MINUTE)])
    run(spark, folder)
    rows = {(g[1], g[5], g[6]): g[3] for g in got(spark, folder)}
    assert rows[1, "failed", "expired"] == START + 30 * MINUTE and rows[2, "completed", "moved"] == START + 30 * MINUTE
    assert rows[3, "TIMED_OUT", "expired"] == START + 15 * MINUTE and (3, "COMPLETED", "illegal") in rows
    assert rows[4, "expired", "expired"] == START + 60 * MINUTE and rows[5, "timed_out", "expired"] == START + 45 * MINUTE
    assert not any(g[1] == 6 for g in got(spark, folder))
    late = START + 300 * MINUTE  # a deadline that a step moves, and a step that waits for the very time of it
    put(spark, folder, [("job", 7, 12, late, "QUEUED"), ("job", 7, 13, late, "CLAIMED"), ("job", 7, 14, late + 2 * MINUTE, "RUNNING"), ("job", 7, 15, late + 5 * MINUTE, "COMPLETED"), tick(late + 61 * MINUTE)])
    put(spark, folder, [tick(late + 63 * MINUTE)])
    put(spark, folder, [tick(late + 90 * MINUTE)])
    run(spark, folder)
    assert {(g[5], g[6]) for g in got(spark, folder) if g[1] == 7} == {(s, "moved") for s in ("QUEUED", "CLAIMED", "RUNNING", "COMPLETED")}
    put(spark, folder, [("operation", 1, 20, START + MINUTE, "completed")])  # later than the delay allows
    put(spark, folder, [tick(START + 600 * MINUTE)])
    query = run(spark, folder)
    assert (1, "completed", "moved") not in {(g[1], g[5], g[6]) for g in got(spark, folder)}
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) == 1


def test_files_grow_with_the_table_and_batches_stay_whole(spark, tmp_path, monkeypatch):
    """Several files a batch give the rows of one file a batch; a batch cut in two would lose steps to the watermark."""
    data = "/root/testdata/sf0.001"
    one = sorted(map(str, streams.stream_machines(spark, data).collect()))
    monkeypatch.setattr(streams, "STEP_ROWS", 15)
    files = streams._step_files(spark, data, str(tmp_path))
    assert files > 1 and len(list((tmp_path / "in").glob("part-*"))) == 5 * files + 1
    assert sorted(map(str, streams.stream_machines(spark, data).collect())) == one


def test_a_key_has_one_timer_and_few_calls(monkeypatch):
    """Six steps of a key at once set one timer, for the first, in one write of state; one call applies all that is due and sets the next."""

    class Handle:
        calls, value = [], None

        def getValueState(self, *_):  # noqa: N802
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def registerTimer(self, ms):  # noqa: N802
            self.calls.append(("set", ms))

        def deleteTimer(self, ms):  # noqa: N802
            self.calls.append(("deleted", ms))

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 200_000

    fold, handle = M.Fold(), Handle()
    fold.init(handle)
    rows = [M.Row(ms=60_000 * i, seq=i, to_state=s) for i, s in enumerate(["held", "released", "held", "held", "released", "held"], 1)]
    assert not list(fold.handleInputRows(("lock", 1), reversed(rows), None)) and handle.calls == [("set", 60_000), "update"]
    handle.calls = []
    assert [r.seq for r in fold.handleExpiredTimer(("lock", 1), handle, None)] == [1, 2, 3]
    assert handle.calls == [("set", 240_000), "update"]
