"""Queries of the state machines: streams over the events' files, each with the same fold as recursive SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import indexing
from quarry.sources.store import read
from quarry.streaming import machines, windows
from quarry.streaming.windows import shared_folder

ACTIONS = ["start", "fetching", "parsing", "completed", "cancel", "failed"]
CACHED = ["get", "get", "set", "get", "drop"]
#: Jobs here fail after two days, and what is cached lasts one, since a user's events lie hours apart.
JOB_MINUTES, CACHE_SECONDS = 2880, 86_400


def _events(spark: SparkSession, d: str, names: list[str] | None) -> DataFrame:
    """A stream of (key, ts, id, what): a user's events, named in turn by their number or else by their type."""
    rows = windows.read_events(spark, f"{d}/events.parquet").filter("user_id is not null and ts is not null")
    what = F.col("event_type") if names is None else F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    return rows.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), what.alias("what"))


def _run(spark: SparkSession, d: str, name: str, names: list[str] | None, **how) -> DataFrame:
    with machines.rocks(spark):
        return windows.run_to_table(machines.machine(_events(spark, d, names), name, **how), name, "append")


def job_machine_stream(spark, d):
    """Every user's job after each of their events."""
    return _run(spark, d, "jobs", ACTIONS, minutes=JOB_MINUTES).filter("id is not null")


def cache_stream(spark, d):
    """Which reads of a user's cached list are hits."""
    return _run(spark, d, "cache", CACHED, seconds=CACHE_SECONDS)


def completed_stream(spark, d):
    """What a user's poll no longer shows that the one before did; a poll is a day's types of events."""
    return _run(spark, d, "polls", None)


def _refuse(texts: list[str]) -> list:
    raise indexing.Refused("called again")


def provider_cache(spark, d):
    """Vectors of all texts at a second run within the time: the provider, which would refuse, isn't called."""
    docs, path = read(spark, d, "documents").select("doc_id", "text"), shared_folder(spark, "remembered")
    indexing.remembered(docs, "text", path, "2024-01-01 00:00:00", dimensions=indexing.DIMENSIONS)
    again = indexing.remembered(docs, "text", path, "2024-01-01 00:04:59", _refuse)
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return again.select("doc_id", F.size("embedding").alias("dimensions"), F.round(length, 3).alias("length"))


QUERIES = [job_machine_stream, cache_stream, completed_stream, provider_cache]


def _e(names: list[str] | None) -> str:
    what = "event_type" if names is None else f"({names})[(event_id % {len(names)})::int + 1]"
    return f"""e as (select user_id k, epoch_us(ts) us, event_id id, {what} what, row_number() over (partition by user_id order by ts, event_id) i
from events where user_id is not null and ts is not null)"""


_IN = "('pending', 'fetching', 'parsing', 'embedding')"
_LATE = f"(status in {_IN} and us > coalesce(started, created) + {JOB_MINUTES * 60_000_000})"
SQL = {
    "job_machine_stream": f"""with recursive {_e(ACTIONS)}, r(k, i, id, job, status, created, started, ended, is_new) as (
select distinct k, 0::bigint, null::bigint, 0::bigint, null::varchar, null::bigint, null::bigint, null::bigint, false from e union all
select k, i, id, job + new::int, case when new then 'pending' when job = 0 then null when what in ('fetching', 'parsing', 'completed', 'failed') then what
when what = 'cancel' and s in {_IN} then 'cancelled' else s end, case when new then us else created end,
case when new then null when job > 0 and what in ('fetching', 'parsing') then coalesce(started, us) else started end,
case when new then null when job > 0 and (what in ('completed', 'failed') or (what = 'cancel' and s in {_IN})) then us else x end, new
from (select *, what = 'start' and (s is null or s not in {_IN}) new from (select r.k, e.i, e.id, job, created, started, us, what,
case when {_LATE} then 'failed' else status end s, case when {_LATE} then coalesce(started, created) + {JOB_MINUTES * 60_000_000} else ended end x
from r join e on e.k = r.k and e.i = r.i + 1)))
select k repository, id, nullif(job, 0) job, status, is_new, started, ended from r where i > 0""",
    "cache_stream": f"""with recursive {_e(CACHED)}, r(k, i, id, since, hit) as (select distinct k, 0::bigint, null::bigint, null::bigint, false from e union all
select k, i, id, case what when 'drop' then null when 'set' then us when 'get' then case when hit then since else us end else since end, hit
from (select r.k, e.i, e.id, since, us, what, what = 'get' and since is not null and us < since + {CACHE_SECONDS * 1_000_000} hit from r join e on e.k = r.k and e.i = r.i + 1))
select k as key, id, hit from r where i > 0""",
    "completed_stream": f"""with {_e(None)}, p as (select k, us // 86400000000 as day, list(distinct what) seen from e group by all),
q as (select *, lag(seen) over (partition by k order by day) before, lead(day) over (partition by k order by day) next from p)
select k as owner, day, unnest(list_filter(before, lambda x: not list_contains(seen, x))) gone from q where before is not null and next is not null""",
    "provider_cache": r"""select doc_id, 1024 dimensions, case when regexp_matches(coalesce(text, ''), '\S') then 1.0 else 0.0 end::double length from documents""",
}
