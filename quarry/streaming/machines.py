"""State machines per key with typed state and event-time timers (`transformWithState`).

Each is a fold over a key's events in the order of (time, id); what a key holds between micro-batches is one small row of
state, in RocksDB. The events of a key in one micro-batch are put in order first (their times, ids and names, no more),
and micro-batches must come in order of time. `folded` runs the same fold over a static table, batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNNING = ("fetching", "parsing", "embedding")
IN_PROGRESS = ("pending", *RUNNING)
ENDED = ("completed", "failed", "cancelled")
STALE_MINUTES, CACHE_SECONDS = 30, 300
_MINUTE, _SECOND, _DAY = 60_000_000, 1_000_000, 86_400_000_000

JOB = "job long, status string, created long, started long, ended long"


def job_step(state: tuple | None, us: int, action: str, minutes: int = STALE_MINUTES) -> tuple[tuple | None, bool]:
    """(state, is_new) of a repository's job after an action. `start` gives the job that is in progress, or a new one; a
    running status sets the start once; an ending one sets the end; `cancel` ends only what is in progress. A job whose
    start (or else creation) is longer ago than `minutes` has failed in between."""
    state = lapsed(state, us, minutes)
    job, status, created, started, ended = state or (0, None, None, None, None)
    if action == "start":
        return (state, False) if status in IN_PROGRESS else ((job + 1, "pending", us, None, None), True)
    if state is None:
        return None, False
    if action in RUNNING:
        return (job, action, created, us if started is None else started, ended), False
    if action in ENDED[:2]:
        return (job, action, created, started, us), False
    if action == "cancel" and status in IN_PROGRESS:
        return (job, "cancelled", created, started, us), False
    return state, False


def lapsed(state: tuple | None, us: int, minutes: int = STALE_MINUTES) -> tuple | None:
    """The state at a time: failed, if the job was in progress for longer than `minutes`."""
    if state is None or state[1] not in IN_PROGRESS:
        return state
    end = (state[2] if state[3] is None else state[3]) + minutes * _MINUTE
    return state if us <= end else (state[0], "failed", state[2], state[3], end)


def cache_step(state: tuple | None, us: int, action: str, seconds: int = CACHE_SECONDS) -> tuple[tuple | None, bool]:
    """(state, hit) of a cache's key: `get` hits what was set within `seconds`, and sets it otherwise; `set` sets it, `drop`
    ends it, other actions do nothing."""
    if action == "drop":
        return None, False
    hit = action == "get" and state is not None and us < state[0] + seconds * _SECOND
    return ((us,) if action == "set" or (action == "get" and not hit) else state), hit


def poll_step(state: tuple | None, us: int, seen: str) -> tuple[tuple, list[str] | None]:
    """(state, gone): what was seen at the last poll and no more at the one that ends with this event; a poll is a day's
    events, and ends with a later day's first."""
    day = us // _DAY
    if state is None:
        return (day, [seen], []), None
    now, current, before = state
    if day <= now:
        return (now, current if seen in current else [*current, seen], before), None
    return (day, [seen], current), sorted(set(before) - set(current))


class _Machine(StatefulProcessor):
    """A fold of events (us, id, what): `step` gives state and rows."""

    schema = ""

    def __init__(self, **how):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def rows(self, key, events: list[tuple], state):
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted(x for part in rows for x in part[["us", "id", "what"]].itertuples(index=False, name=None))
        state = tuple(self.state.get()) if self.state.exists() else None
        state, out = self.rows(key, events, state)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        self.timed(state)
        yield pd.DataFrame(out, columns=self.columns)

    def timed(self, state) -> None:
        """Set the timers that the new state needs."""

    def close(self) -> None:
        pass


class Jobs(_Machine):
    schema = JOB
    columns = ["repository", "id", "job", "status", "is_new", "started", "ended"]

    def rows(self, key, events, state):
        out = []
        for us, i, what in events:
            state, new = job_step(state, us, what, **self.how)
            job, status, _, started, ended = state or (None,) * 5
            out.append((key[0], i, job, status, new, started, ended))
        return state, out

    def timed(self, state) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if state is not None and state[1] in IN_PROGRESS:
            began = state[2] if state[3] is None else state[3]
            self.handle.registerTimer(began // 1000 + self.how.get("minutes", STALE_MINUTES) * 60_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A job of which nothing came in time has failed; a row without an event's id."""
        before = tuple(self.state.get()) if self.state.exists() else None
        state = lapsed(before, expiredTimerInfo.getExpiryTimeInMs() * 1000 + 999, **self.how)
        if state is not None and state != before:
            self.state.update(state)
            yield pd.DataFrame([(key[0], None, state[0], state[1], False, state[3], state[4])], columns=self.columns)


class Cache(_Machine):
    schema = "at long"
    columns = ["key", "id", "hit"]

    def rows(self, key, events, state):
        out = []
        for us, i, what in events:
            state, hit = cache_step(state, us, what, **self.how)
            out.append((key[0], i, hit))
        return state, out

    def timed(self, state) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if state is not None:
            self.handle.registerTimer(state[0] // 1000 + self.how.get("seconds", CACHE_SECONDS) * 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What has expired takes no room any more."""
        self.state.clear()
        yield pd.DataFrame([], columns=self.columns)


class Polls(_Machine):
    schema = "day long, current array<string>, before array<string>"
    columns = ["owner", "day", "gone"]

    def rows(self, key, events, state):
        out = []
        for us, _, what in events:
            day = None if state is None else state[0]
            state = None if state is None else (state[0], list(state[1]), list(state[2]))
            state, gone = poll_step(state, us, what)
            out += [(key[0], day, g) for g in gone or ()]
        return state, out


MACHINES = {
    "jobs": (Jobs, "repository long, id long, job long, status string, is_new boolean, started long, ended long"),
    "cache": (Cache, "key long, id long, hit boolean"),
    "polls": (Polls, "owner long, day long, gone string"),
}


@contextmanager
def rocks(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which typed state needs."""
    name, own = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, own)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def machine(events: DataFrame, name: str, late: str = "10 minutes", **how) -> DataFrame:
    """A stream of events (key, ts, id, what) run through a machine: jobs (`minutes`), cache (`seconds`) or polls."""
    kind, out = MACHINES[name]
    rows = events.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("us"), "id", "what")
    return rows.groupBy("key").transformWithStateInPandas(kind(**how), outputStructType=out, outputMode="append", timeMode="eventTime")
