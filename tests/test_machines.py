"""Machines with typed state against the same folds in Python, over several micro-batches."""

import pytest
from pyspark.sql import functions as F

from quarry.streaming import machines as M
from quarry.streaming import windows

MINUTE = 60_000_000
ACTIONS = ["start", "fetching", "parsing", "completed", "cancel", "failed"]


def test_job_steps():
    state, new = M.job_step(None, 5, "start")
    assert new and state == (1, "pending", 5, None, None)
    assert M.job_step(state, 6, "start") == (state, False)
    state, _ = M.job_step(state, 7, "fetching")
    assert state == (1, "fetching", 5, 7, None)
    assert M.job_step(state, 9, "parsing")[0] == (1, "parsing", 5, 7, None)
    done, _ = M.job_step(state, 11, "completed")
    assert done == (1, "completed", 5, 7, 11) and M.job_step(done, 12, "cancel") == (done, False)
    assert M.job_step(state, 12, "cancel")[0] == (1, "cancelled", 5, 7, 12)
    assert M.job_step(done, 20, "start") == ((2, "pending", 20, None, None), True)
    assert M.job_step(state, 7 + 30 * MINUTE, "start") == (state, False)
    assert M.lapsed(state, 8 + 30 * MINUTE) == (1, "failed", 5, 7, 7 + 30 * MINUTE)
    assert M.job_step(state, 8 + 30 * MINUTE, "start")[1] and M.job_step(None, 1, "cancel") == (None, False)


def test_cache_steps():
    state, hit = M.cache_step(None, 0, "get")
    assert state == (0,) and not hit
    assert M.cache_step(state, 299_999_999, "get") == ((0,), True) and M.cache_step(state, 300_000_000, "get") == ((300_000_000,), False)
    assert M.cache_step(state, 5, "drop") == (None, False) and M.cache_step(state, 5, "set") == ((5,), False) and M.cache_step(state, 5, "x") == (state, False)


@pytest.fixture(scope="module")
def events(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("machines") / "events.parquet")
    rows = spark.read.parquet(f"{small}/events.parquet").orderBy("ts")
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    return path


def named(rows, names):
    one_of = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    return rows.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), one_of.alias("what"))


def folded(spark, path, names):
    by = {}
    for r in named(spark.read.parquet(path), names).select("key", F.unix_micros("ts").alias("us"), "id", "what").collect():
        by.setdefault(r["key"], []).append((r["us"], r["id"], r["what"]))
    return {k: sorted(v) for k, v in by.items()}


def streamed(spark, path, names, name):
    with M.rocks(spark):
        return [tuple(r) for r in windows.run_to_table(M.machine(named(windows.read_events(spark, path), names), name), name, "append").collect()]


def test_jobs(spark, events):
    want, left = set(), {}
    every = folded(spark, events, ACTIONS)
    for key, rows in every.items():
        state = None
        for us, i, what in rows:
            state, new = M.job_step(state, us, what)
            want.add((key, i, *((state[0], state[1]) if state else (None, None)), new, *((state[3], state[4]) if state else (None, None))))
        left[key] = state
    got = streamed(spark, events, ACTIONS, "jobs")
    assert {r for r in got if r[1] is not None} == want
    heard = max(us for rows in every.values() for us, _, _ in rows) - 10 * MINUTE
    late = {(k, s[0]) for k, s in left.items() if s and M.lapsed(s, heard - 2000) != s}
    assert late and late <= {(r[0], r[2]) for r in got if r[1] is None and r[3] == "failed"}


def test_cache(spark, events):
    names, want = ["get", "get", "set", "get", "drop"], set()
    for key, rows in folded(spark, events, names).items():
        state = None
        for us, i, what in rows:
            state, hit = M.cache_step(state, us, what)
            want.add((key, i, hit))
    assert set(streamed(spark, events, names, "cache")) == want


def test_polls(spark, events):
    want, names = set(), ["a", "b", "c"]
    for key, rows in folded(spark, events, names).items():
        state = None
        for us, _, what in rows:
            day = None if state is None else state[0]
            state, gone = M.poll_step(state, us, what)
            want |= {(key, day, g) for g in gone or ()}
    assert want and set(streamed(spark, events, names, "polls")) == want
