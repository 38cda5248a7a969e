"""State per key: rate limits and jobs, with `applyInPandasWithState`.

The state of a key is a few numbers (or the times of the requests in one window), so it stays small however long the
stream runs; the same rules exist as batch operators in `quarry.operators.usage`, and tests compare the two.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Rows that a task gives back at a time.
OUT = 10_000


def _in_order(batches) -> tuple[np.ndarray, np.ndarray]:
    """Times and ids of a key's requests in one micro-batch, sorted: sixteen bytes for each."""
    parts = [(b["us"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64)) for b in batches]
    us, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, us))
    return us[order], ids[order]


def sliding_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, event_id, n_window, allowed): a log of each key's requests within the window; refused ones count."""
    width = seconds * 1_000_000

    def run(key, batches, state: GroupState):
        us, ids = _in_order(batches)
        every = np.sort(np.concatenate((np.array(state.get[0] if state.exists else [], np.int64), us)))
        n = np.searchsorted(every, us, "right") - np.searchsorted(every, us - width, "right")
        state.update((every[every > every[-1] - width].tolist(),))
        for a in range(0, len(us), OUT):
            some = slice(a, a + OUT)
            yield pd.DataFrame({"user_id": key[0], "event_id": ids[some], "n_window": n[some], "allowed": n[some] <= limit})

    timed = requests.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, n_window long, allowed boolean", "times array<long>", "append", GroupStateTimeout.NoTimeout
    )


def fixed_limit(requests: DataFrame, limit: int, seconds: int) -> DataFrame:
    """(user_id, event_id, n_window, allowed): windows that a key's first request opens."""
    width = seconds * 1_000_000

    def run(key, batches, state: GroupState):
        reset, n = state.get if state.exists else (None, 0)
        us, ids = _in_order(batches)
        place = np.empty(len(us), np.int64)
        for i, at in enumerate(us.tolist()):
            if reset is None or reset < at:
                reset, n = at + width, 0
            n += 1
            place[i] = n
        state.update((int(reset), int(n)))
        for a in range(0, len(us), OUT):
            some = slice(a, a + OUT)
            yield pd.DataFrame({"user_id": key[0], "event_id": ids[some], "n_window": place[some], "allowed": place[some] <= limit})

    timed = requests.select("user_id", "event_id", F.unix_micros("ts").alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, event_id long, n_window long, allowed boolean", "reset long, n long", "append", GroupStateTimeout.NoTimeout
    )


def job_states(log: DataFrame, terminal: list[str], minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """(job, status, at): the last status of each job after each batch, and when it came (microseconds); a job that
    hasn't ended and of which nothing is heard for so many minutes of event time is failed."""

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            at, status = state.get
            state.remove()
            if status not in terminal:
                yield pd.DataFrame([(key[0], "failed", at)], columns=["job", "status", "at"])
            return
        at, status = state.get if state.exists else (-1, None)
        for us, said in pd.concat(list(batches)).sort_values(["us", "seq"])[["us", "status"]].itertuples(index=False):
            if us >= at:
                at, status = us, said
        state.update((int(at), status))
        state.setTimeoutTimestamp(max(int(at) // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], status, at)], columns=["job", "status", "at"])

    rows = log.withWatermark("ts", late).select("job", "status", "seq", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("job").applyInPandasWithState(
        run, "job long, status string, at long", "at long, status string", "update", GroupStateTimeout.EventTimeTimeout
    )
