"""Streams over several files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import usage
from quarry.streaming import state, windows


@pytest.fixture(scope="module")
def events(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "events.parquet")
    rows = spark.read.parquet(f"{small}/events.parquet").orderBy("ts")
    rows.repartitionByRange(3, "event_id").write.parquet(path)
    return path


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def batch(spark, path):
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize("window", [windows.tumbling, windows.sliding, windows.sessions])
def test_windows(spark, events, window):
    assert same(window(batch(spark, events)), windows.run_to_table(window(windows.read_events(spark, events)), window.__name__))


def test_sliding_limit(spark, events):
    got = windows.run_to_table(state.sliding_limit(windows.read_events(spark, events), 3, 86_400), "sliding", "append")
    assert same(usage.sliding_counts(batch(spark, events), "user_id", "ts", 3, 86_400).select("user_id", "event_id", "n_window", "allowed"), got)


def test_fixed_limit(spark, events):
    got = windows.run_to_table(state.fixed_limit(windows.read_events(spark, events), 5, 172_800), "fixed", "append")
    assert same(usage.fixed_windows(batch(spark, events), "user_id", "ts", 5, 172_800, "event_id"), got)


def test_job_states(spark, events):
    log = windows.read_events(spark, events).select(F.col("user_id").alias("job"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"), "ts")
    got = {(r["job"], r["status"], r["at"]) for r in windows.run_to_table(state.job_states(log, ["purchase"]), "jobs", "update").collect()}
    rows = batch(spark, events).withColumn("us", F.unix_micros("ts"))
    last = usage.latest(rows, "user_id", [F.desc("ts"), F.desc("event_id")]).collect()
    heard = max(r["us"] for r in last) - 600 * 1_000_000  # the watermark at the end
    for r in last:
        assert (r["user_id"], r["event_type"], r["us"]) in got
        lost = r["event_type"] != "purchase" and r["us"] + 1800 * 1_000_000 < heard - 1000
        assert ((r["user_id"], "failed", r["us"]) in got) == lost
