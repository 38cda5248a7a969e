"""Usage, limits, jobs and conversations: `events` are usage rows (tokens in props), `customer` are accounts, `orders`
their repositories and jobs, `conversations` messages. Also the routing of questions, on `benchmark` and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import routing as Q
from quarry.functions import text as T
from quarry.operators import usage as U
from quarry.sources.store import read
from quarry.streaming import state, windows

NOW = "1998-08-20 15:00:00"
PURPOSES = {"click": "chat", "view": "default", "signup": "checkout", "purchase": "strict", "error": "indexation"}
BUCKETS = ["today", "yesterday", "this_week", "this_month", "older"]


def _usage(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.when(F.col("value") >= 20, "chat").otherwise("haiku").alias("model"),
        U.tokens_of(F.col("props")).alias("tokens"),
    )


def usage_total(spark, d):
    return U.totals(_usage(spark, d))


def usage_by_type(spark, d):
    return U.totals(_usage(spark, d), [F.col("event_type")])


def usage_by_model(spark, d):
    return U.totals(_usage(spark, d), [F.col("model")])


def usage_by_bucket(spark, d):
    return U.totals(_usage(spark, d), [F.when(F.col("event_type") == "click", "chat").otherwise("indexing").alias("bucket")])


def usage_grouping_sets(spark, d):
    return U.rollup(_usage(spark, d), "event_type", "model")


def _limits(spark, d) -> DataFrame:
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "plus").when(F.col("c_mktsegment") == "MACHINERY", "pro").when(
        F.col("c_mktsegment") == "HOUSEHOLD", "free").otherwise("business")
    accounts = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), plan.alias("plan"), F.to_timestamp(F.lit("2024-01-10")).alias("period_start"))
    repos = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    chat = _usage(spark, d).filter("event_type = 'click'").withColumn("tokens", F.col("tokens") * 100)
    return U.limits(accounts, chat, repos, U.plans(spark))


def plan_limits(spark, d):
    return _limits(spark, d)


def limit_gates(spark, d):
    status = F.when(F.col("user_id") % 7 == 3, "past_due").otherwise("active")
    return U.allowed(_limits(spark, d), status).groupBy("plan").agg(
        F.count("*").alias("n"), F.count_if("may_chat").alias("may_chat"), F.count_if("may_connect").alias("may_connect"))


def conversation_list(spark, d):
    names = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = U.conversation_list(read(spark, d, "customer"), read(spark, d, "orders"), names, "c_custkey", "o_custkey", "c_nationkey")
    return out.select("c_custkey", "n_name", "n_children")


def history_last_n(spark, d):
    return U.last_n(read(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 3)


def new_message_antijoin(spark, d):
    c = read(spark, d, "conversations")
    return U.unseen(c.filter("turn = 0").select("conv_id", "text"), c.filter("turn > 0"), "text").select("conv_id")


def indexed_repos_join(spark, d):
    """Accounts whose last order is completed."""
    last = U.latest(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    joined = read(spark, d, "customer").select("c_custkey", "c_name").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.filter("o_orderstatus = 'F'").select("c_custkey", "c_name", "o_orderkey")


def _jobs(spark, d) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "view", "fetching").when(F.col("event_type") == "click", "parsing").when(
        F.col("event_type") == "purchase", "completed").otherwise("failed")
    log = _usage(spark, d).select(F.col("user_id").alias("job"), "event_id", "ts", status.alias("status"))
    return U.latest(log, "job", [F.desc("ts"), F.desc("event_id")])


def latest_job_state(spark, d):
    return _jobs(spark, d).select("job", "event_id", "status", U.status_class(F.col("status")).alias("class"))


def stale_jobs(spark, d):
    jobs = _jobs(spark, d).select("job", "status", F.when(F.col("job") % 2 == 0, F.col("ts")).alias("started_at"), F.col("ts").alias("created_at"))
    return U.stale(jobs, F.to_timestamp(F.lit("2024-01-30 20:00:00"))).select("job", "status")


def job_progress(spark, d):
    phase = F.element_at(F.array(*[F.lit(x) for x in [*U.PHASES, "Generating context"]]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", U.phase_progress(phase, F.col("p_size"), F.col("p_partkey") % 50).alias("progress"))


def active_jobs_by_account(spark, d):
    """Open orders of the accounts of a nation."""
    mine = read(spark, d, "customer").filter("c_nationkey = 4").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").filter("o_orderstatus = 'O'").join(mine, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def rate_sliding(spark, d):
    return U.sliding_counts(_usage(spark, d), "user_id", "ts", 3, 86_400).select("event_id", "n_window", "allowed")


def rate_fixed(spark, d):
    return U.fixed_windows(_usage(spark, d), "user_id", "ts", 5, 172_800, "event_id")


def rate_limit_presets(spark, d):
    """For each purpose's limit the events of a type that stand for it, and how many windows of a user's are over it."""
    purpose = F.element_at(F.create_map(*[F.lit(x) for pair in PURPOSES.items() for x in pair]), F.col("event_type"))
    presets = spark.createDataFrame([(k, *v) for k, v in U.RATE_LIMITS.items()], "name string, requests long, seconds long")
    e = read(spark, d, "events").select("user_id", purpose.alias("name"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("s"))
    windows_ = e.join(F.broadcast(presets), "name").groupBy("name", "requests", "user_id", F.floor(F.col("s") / F.col("seconds")).alias("w")).agg(F.count("*").alias("n"))
    counted = windows_.groupBy("name").agg(F.sum("n").alias("events"), F.count_if(F.col("n") > F.col("requests")).alias("over"))
    return presets.join(counted, "name", "left").select("name", "requests", "seconds", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("events", "over")])


def subscription_states(spark, d):
    """Last state of each user's subscription, events standing for those of the payment provider."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "view", "payment_succeeded").when(F.col("event_type") == "click", "payment_failed").when(
        F.col("event_type") == "purchase", "updated").otherwise("deleted")
    rows = _usage(spark, d).select("user_id", "event_id", kind.alias("kind"), F.when(F.col("tokens") > 50, "pro").otherwise("plus").alias("plan"), F.lit("active").alias("status"))
    return U.subscription_states(rows, "user_id", "kind", "event_id")


def _all_buckets(counted: DataFrame) -> DataFrame:
    """Counts of all five groups in their order, also of those without a row."""
    every = counted.sparkSession.createDataFrame(list(enumerate(BUCKETS)), "place int, bucket string")
    return every.join(counted, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n")).orderBy("place")


def date_groups(spark, d):
    now = F.to_timestamp(F.lit(NOW))
    return _all_buckets(read(spark, d, "orders").groupBy(T.calendar_group(F.col("o_orderdate"), now).alias("bucket")).agg(F.count("*").alias("n")))


def date_groups_rolling(spark, d):
    now = F.to_timestamp(F.lit(NOW))
    return _all_buckets(read(spark, d, "orders").groupBy(T.rolling_group(F.col("o_orderdate"), now).alias("bucket")).agg(F.count("*").alias("n")))


def relative_time(spark, d):
    now = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    return _usage(spark, d).select("event_id", T.relative_time(F.col("ts"), now).alias("shown"))


def title_generate(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.title(F.col("text")).alias("title"))


def title_sign(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.title_sign(F.col("text")).alias("sign"))


def number_short(spark, d):
    return read(spark, d, "orders").select("o_orderkey", T.abbreviated((F.col("o_totalprice") * 10).cast("long")).alias("shown"))


def client_keys(spark, d):
    e = read(spark, d, "events")
    user = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string"))
    hops = F.when(F.col("user_id") % 3 == 1, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(", 1.1.1.1")))
    return e.groupBy(T.client_key(user, hops).alias("client")).agg(F.count("*").alias("n"))


def _questions(spark, d) -> DataFrame:
    """Test items and messages, with a lead that makes them questions of several kinds."""
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("what is the api route of ", "list all components: ", "write a function for ", "why ", "", "show me every database table ", "useAuth", "x.y(")]),
        (F.col("id") % 8 + 1).cast("int"),
    )
    a = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    c = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1_000_000).alias("id"), "text")
    return a.unionByName(c).select("id", F.when(F.col("id") % 8 == 6, lead).otherwise(F.concat(lead, F.coalesce("text", F.lit("")))).alias("q"))


def query_form(spark, d):
    return _questions(spark, d).select("id", Q.form(F.col("q")).alias("form"))


def _classified(spark, d) -> DataFrame:
    return _questions(spark, d).withColumn("scores", Q.subject_scores(F.col("q"))).withColumn("s", Q.classified(F.col("scores"), F.col("q")))


def classify_query(spark, d):
    return _classified(spark, d).select("id", "s.type", "s.is_list", F.round("s.confidence", 6).alias("confidence"))


def strategy_route(spark, d):
    return _classified(spark, d).select("id", Q.strategy(F.col("q"), F.col("s")).alias("strategy"))


def model_route(spark, d):
    r = _questions(spark, d).withColumn("r", Q.model(F.col("q"), F.length("q").cast("long") * 5))
    return r.select("id", "r.complexity", "r.model", F.round("r.confidence", 6).alias("confidence"))


def query_expansion(spark, d):
    return _questions(spark, d).select("id", F.array_join(Q.expanded_words(F.col("q")), " ").alias("words"))


def expansion_patterns(spark, d):
    """Path patterns and the search string of each question's expansion; its words stand for keywords and paths."""
    q = _questions(spark, d).select("id", "q", Q.expanded_words(F.lower("q")).alias("ws"))
    patterns = Q.path_patterns(F.slice("ws", 1, 3), F.lower("q").contains("api"))
    said = Q.search_words(F.slice("ws", 1, 4), F.when(F.size("ws") > 4, F.slice("ws", 5, 2)))
    return q.select("id", F.array_join(F.array_sort(patterns), "|").alias("patterns"), said.alias("said"))


def routing_savings(spark, d):
    r = _questions(spark, d).select(Q.model(F.col("q"))["model"].alias("model"), F.length("q").cast("long").alias("n"))
    return U.routing_savings(r, "model", F.col("n") + 100, F.lit(500))


def tumbling_usage(spark, d):
    return windows.tumbling(_values(spark, d))


def sliding_usage(spark, d):
    return windows.sliding(_values(spark, d))


def session_usage(spark, d):
    return windows.sessions(_values(spark, d))


def _values(spark, d) -> DataFrame:
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_usage_stream(spark, d):
    """The same windows from a stream over the events' files."""
    return windows.run_to_table(windows.tumbling(windows.read_events(spark, f"{d}/events.parquet")), "tumbling")


def rate_sliding_stream(spark, d):
    """The sliding limit with state per user, from a stream over the events' files."""
    found = state.sliding_limit(windows.read_events(spark, f"{d}/events.parquet"), 3, 86_400)
    return windows.run_to_table(found, "rate", "append").select("event_id", "n_window", "allowed")


QUERIES = [
    usage_total, usage_by_type, usage_by_model, usage_by_bucket, usage_grouping_sets, plan_limits, limit_gates, conversation_list, history_last_n,
    new_message_antijoin, indexed_repos_join, latest_job_state, stale_jobs, job_progress, active_jobs_by_account, rate_sliding, rate_fixed,
    rate_limit_presets, subscription_states, date_groups, date_groups_rolling, relative_time, title_generate, title_sign, number_short,
    expansion_patterns, client_keys, query_form, classify_query, strategy_route, model_route, query_expansion, routing_savings, tumbling_usage, sliding_usage,
    session_usage, tumbling_usage_stream, rate_sliding_stream,
]

_U = """u as (select event_id, ts, user_id, event_type, case when value >= 20 then 'chat' else 'haiku' end model, (props->>'k')::bigint tokens from events)"""
_SUM = "count(*) events, coalesce(sum(tokens), 0)::bigint tokens"
_L = f"""{_U}, p(plan, token_limit, repo_limit) as (values ('free', 40000, 1), ('plus', 1000000, 5), ('pro', 4000000, -1)),
a as (select c_custkey user_id, case c_mktsegment when 'BUILDING' then 'plus' when 'MACHINERY' then 'pro' else 'free' end plan from customer),
t as (select user_id, sum(tokens * 100) n from u where event_type = 'click' and ts >= timestamp '2024-01-10' group by 1),
o as (select o_custkey user_id, count(*) n from orders group by 1),
j as (select a.user_id, plan, coalesce(t.n, 0)::bigint tokens_used, token_limit::bigint token_limit, coalesce(o.n, 0) repos_used, repo_limit::bigint repo_limit
from a join p using (plan) left join t using (user_id) left join o using (user_id)),
lim as (select user_id, plan, tokens_used, token_limit, greatest(token_limit - tokens_used, 0) tokens_left, least(round(tokens_used * 100.0 / token_limit), 100)::bigint percent,
tokens_used >= token_limit tokens_reached, repos_used, repo_limit, repo_limit <> -1 and repos_used >= repo_limit repos_reached from j)"""
_J = f"""{_U}, j as (select user_id job, event_id, ts, case event_type when 'signup' then 'pending' when 'view' then 'fetching' when 'click' then 'parsing'
when 'purchase' then 'completed' else 'failed' end status from u qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"""
_Q = """r as (select item_id id, text from benchmark union all select conv_id * 100 + turn + 1000000, text from conversations),
q as (select id, case when id % 8 = 6 then 'useAuth' else (['what is the api route of ', 'list all components: ', 'write a function for ', 'why ', '', 'show me every database table ', 'useAuth', 'x.y('])[(id % 8)::int + 1]
|| coalesce(text, '') end q from r), t as (select id, q, regexp_replace(q, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') tr from q)"""


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FORM = "case when regexp_matches(tr, '^[a-zA-Z_][a-zA-Z0-9_]*$') then 'identifier' when " + " or ".join(f"regexp_matches(tr, {_lit(p)})" for p in Q.CODE_LIKE) + " then 'code' else 'natural_language' end"
_SCORES = [(name, " + ".join(f"(case when contains(lower(tr), {_lit(k)}) then {len(k)} else 0 end)" for k in keys)) for name, keys in Q.SUBJECTS.items()]
_C = f"""{_Q}, sc as (select id, tr, {', '.join(f'{e} s{i}' for i, (_, e) in enumerate(_SCORES))}, {' or '.join(f'contains(lower(tr), {_lit(w)})' for w in Q.LIST_WORDS)} is_list from t),
mx as (select *, greatest({', '.join(f's{i}' for i in range(len(_SCORES)))}) best from sc),
cl as (select id, tr, case when best = 0 then 'GENERIC' {' '.join(f"when s{i} = best then '{name}'" for i, (name, _) in enumerate(_SCORES))} end as type, is_list, round(least(best / 20.0, 1.0), 6)::double confidence from mx)"""
_N = "len(string_split_regex(q, '[ \\t\\n\\r]+'))"
_ANY = lambda tests: "(" + " or ".join(tests) + ")"
_MODEL_CASES = [
    (_ANY([f"regexp_matches(q, {_lit('(?i)' + p)})" for p in Q.CODE_TASKS]), "complex", "chat", 0.9),
    (_ANY([f"contains(lower(tr), {_lit(w)})" for w in Q.COMPLEX_WORDS]), "complex", "chat", 0.85),
    (f"{_N} < 20 and " + _ANY([f"starts_with(lower(tr), {_lit(w)}) or contains(lower(tr), {_lit(' ' + w)})" for w in Q.SIMPLE_WORDS]), "simple", "haiku", 0.8),
    (f"{_N} < 8", "simple", "haiku", 0.7),
    (f"{_N} > 50", "complex", "chat", 0.75),
]
_PICK = lambda i, last: "case " + " ".join(f"when {c[0]} then {_lit(c[i]) if isinstance(c[i], str) else c[i]}" for c in _MODEL_CASES) + f" else {last} end"
_M = f"{_Q}, m as (select id, q, {_PICK(1, _lit('moderate'))} complexity, {_PICK(2, _lit('chat'))} model, ({_PICK(3, 0.6)})::double confidence from t)"
_AGO = "floor(epoch(timestamp '{0}' - {1}))::bigint"

_ALL_BUCKETS = f"select place::int place, b.bucket, coalesce(n, 0)::bigint n from (select unnest({BUCKETS}) bucket, unnest(range(5)) place) b left join"

SQL = {
    "subscription_states": """with e as (select user_id, event_id o, case event_type when 'signup' then 'created' when 'view' then 'payment_succeeded' when 'click' then 'payment_failed'
when 'purchase' then 'updated' else 'deleted' end kind, case when json_extract(props, '$.k')::bigint > 50 then 'pro' else 'plus' end plan from events),
g as (select user_id, max(o) filter (kind = 'created') made, max(o) filter (kind = 'deleted') ended, max(o) filter (kind = 'payment_succeeded') paid, max(o) filter (kind = 'payment_failed') failed,
max(o) filter (kind in ('created', 'updated')) given from e group by 1)
select g.user_id, case when made is null then 'none' when ended > made then 'canceled' when failed > given and not coalesce(paid > failed, false) then 'past_due' else 'active' end status,
case when made is null or ended > made then 'free' else plan end plan from g left join e on e.user_id = g.user_id and e.o = given""",
    "usage_total": f"with {_U} select {_SUM} from u",
    "usage_by_type": f"with {_U} select event_type, {_SUM} from u group by 1",
    "usage_by_model": f"with {_U} select model, {_SUM} from u group by 1",
    "usage_by_bucket": f"with {_U} select case when event_type = 'click' then 'chat' else 'indexing' end bucket, {_SUM} from u group by 1",
    "usage_grouping_sets": f"""with {_U} select 'total' as level, '' as key, {_SUM} from u union all select 'event_type', event_type, {_SUM} from u group by event_type
union all select 'model', model, {_SUM} from u group by model""",
    "plan_limits": f"with {_L} select * from lim",
    "limit_gates": f"""with {_L} select plan, count(*) n, count(*) filter (user_id % 7 <> 3 and not tokens_reached) may_chat,
count(*) filter (user_id % 7 <> 3 and not repos_reached) may_connect from lim group by 1""",
    "conversation_list": "select c_custkey, n_name, count(o_orderkey) n_children from customer left join nation on n_nationkey = c_nationkey left join orders on o_custkey = c_custkey group by all",
    "history_last_n": """with n as (select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3)
select *, row_number() over (partition by conv_id order by turn)::int place from n""",
    "new_message_antijoin": "select conv_id from conversations where turn = 0 and text not in (select text from conversations where turn > 0 and text is not null)",
    "indexed_repos_join": """with l as (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)
select c_custkey, c_name, o_orderkey from customer join l on o_custkey = c_custkey where o_orderstatus = 'F'""",
    "latest_job_state": f"with {_J} select job, event_id, status, case when status in ('pending', 'fetching', 'parsing') then 'in_progress' else 'terminal' end class from j",
    "stale_jobs": f"with {_J} select job, status from j where status in ('pending', 'fetching', 'parsing') and ts < timestamp '2024-01-30 19:30:00'",
    "job_progress": """with p as (select p_partkey, (p_partkey % 6)::int ph, p_size / nullif(p_partkey % 50, 0)::double s from part)
select p_partkey, least(greatest(coalesce(case ph when 0 then s * 0 when 1 then round(s * 10) when 2 then 10 + round(s * 40) when 3 then 50 + round(s * 45) when 4 then 95 + s * 0 else round(s * 100) end, 0), 0), 100)::int progress from p""",
    "active_jobs_by_account": "select o_orderkey, o_custkey from orders where o_orderstatus = 'O' and o_custkey in (select c_custkey from customer where c_nationkey = 4)",
    "rate_sliding": """with e as (select event_id, user_id, epoch_us(ts) us from events),
w as (select event_id, count(*) over (partition by user_id order by us range between 86399999999 preceding and current row) n_window from e) select *, n_window <= 3 allowed from w""",
    "rate_limit_presets": """with p as (select * from (values ('chat', 'click', 20::bigint, 60::bigint), ('indexation', 'error', 5, 60), ('checkout', 'signup', 10, 60), ('default', 'view', 60, 60),
('strict', 'purchase', 5, 300)) t(name, event_type, requests, seconds)),
w as (select name, user_id, (epoch_us(ts) // 1000000) // seconds w, count(*) n, any_value(requests) most from events join p using (event_type) group by 1, 2, 3),
c as (select name, sum(n)::bigint events, count(*) filter (n > most) over_ from w group by 1)
select name, requests, seconds, coalesce(events, 0)::bigint events, coalesce(over_, 0)::bigint "over" from p left join c using (name)""",
    "date_groups": f"""{_ALL_BUCKETS} (select case when o_orderdate::date >= date '1998-08-20' then 'today' when o_orderdate::date = date '1998-08-19' then 'yesterday'
when o_orderdate::date >= date '1998-08-17' then 'this_week' when o_orderdate::date >= date '1998-08-01' then 'this_month' else 'older' end bucket, count(*) n from orders group by 1) c on c.bucket = b.bucket""",
    "date_groups_rolling": f"""with d as (select floor({_AGO.format(NOW, 'o_orderdate')} / 86400.0) nd from orders)
, c as (select case when nd <= 0 then 'today' when nd = 1 then 'yesterday' when nd < 7 then 'this_week' when nd < 30 then 'this_month' else 'older' end bucket, count(*) n from d group by 1) {_ALL_BUCKETS} c on c.bucket = b.bucket""",
    "relative_time": f"""with d as (select event_id, ts, {_AGO.format('2024-01-31 00:00:00', 'ts')} s from events)
select event_id, case when s < 60 then 'à l''instant' when s < 3600 then 'il y a ' || (s // 60) || ' minute' || case when s // 60 > 1 then 's' else '' end
when s < 86400 then 'il y a ' || (s // 3600) || ' heure' || case when s // 3600 > 1 then 's' else '' end when s // 86400 = 1 then 'hier'
when s // 86400 < 7 then 'il y a ' || (s // 86400) || ' jours' when s // 86400 < 30 then 'il y a ' || (s // 604800) || ' semaine' || case when s // 604800 > 1 then 's' else '' end
else strftime(ts, '%Y-%m-%d') end shown from d""",
    "title_generate": """with t as (select conv_id, turn, regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') t from conversations),
h as (select *, substr(t, 1, 50) h, strpos(reverse(substr(t, 1, 50)), ' ') p from t)
select conv_id, turn, case when length(t) <= 50 then t when p > 0 and 51 - p > 1 then substr(h, 1, 50 - p) || '...' else h || '...' end title from h""",
    "title_sign": "select conv_id, turn, case " + " ".join(f"when regexp_matches(lower(coalesce(text, '')), '{'|'.join(k)}') then '{s}'" for k, s in T.TITLE_SIGNS) + f" else '{T.OTHER_SIGN}' end sign from conversations",
    "number_short": """with n as (select o_orderkey, trunc(o_totalprice * 10)::bigint n from orders) select o_orderkey, case when n >= 1000000 then round(n / 1000000.0, 1)::decimal(20, 1)::varchar || 'M'
when n >= 1000 then round(n / 1000.0)::bigint::varchar || 'k' else n::varchar end shown from n""",
    "client_keys": "select case user_id % 3 when 0 then 'user:' || user_id when 1 then 'ip:10.0.0.' || user_id else 'unknown' end client, count(*) n from events group by 1",
    "expansion_patterns": f"""with {_Q}, w as (select id, q, list_filter(string_split_regex(lower(q), '[ \\t\\n\\r]+'), lambda x: length(x) > 3) ws from q)
select id, array_to_string(list_sort(list_distinct(list_concat(list_transform(ws[1:3], lambda x: '%' || x || '%'), case when contains(lower(q), 'api') then
['%lib/%', '%api/%', '%services/%', '%config%'] else [] end))), '|') patterns, array_to_string(list_concat(ws[1:4], ws[5:6]), ' ') said from w""",
    "query_form": f"with {_Q} select id, {_FORM} form from t",
    "classify_query": f"with {_C} select id, type, is_list, confidence from cl",
    "strategy_route": f"""with {_C} select id, case when regexp_matches(tr, '^[a-zA-Z_][a-zA-Z0-9_]*$') then 'symbol' when type <> 'GENERIC' and is_list and confidence >= 0.3 then 'metadata'
else 'hybrid_v2' end strategy from cl""",
    "model_route": f"""with {_M} select id, complexity, case when model = 'haiku' and length(q) * 5 > 5000 then 'chat' else model end model,
round(case when model = 'haiku' and length(q) * 5 > 5000 then confidence * 0.9 else confidence end, 6) confidence from m""",
    "query_expansion": f"with {_Q} select id, array_to_string(list_filter(string_split_regex(q, '[ \\t\\n\\r]+'), lambda w: length(w) > 3), ' ') words from q",
    "routing_savings": f"""with {_M}, c as (select model = 'haiku' small, length(q) + 100 i, 500 o from m) select count(*) n, count(*) filter (small) small_model, count(*) filter (not small) large_model,
coalesce(round((sum(i * 3.0 + o * 15.0) - sum(case when small then i * 0.25 + o * 1.25 else i * 3.0 + o * 15.0 end)) * 100 / sum(i * 3.0 + o * 15.0)), 0)::bigint saved_percent from c""",
    "tumbling_usage": "select date_trunc('day', ts)::timestamp start, event_type, count(*) events, round(sum(value), 4) \"value\" from events group by all",
    "sliding_usage": """with s as (select date_trunc('day', ts)::timestamp start, event_type from events union all select date_trunc('day', ts)::timestamp - interval 1 day, event_type from events)
select start, event_type, count(*) events from s group by all""",
    "session_usage": """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end new from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts) n from g) select user_id, min(ts) start, count(*) events from s group by user_id, n""",
}
SQL["tumbling_usage_stream"], SQL["rate_sliding_stream"] = SQL["tumbling_usage"], SQL["rate_sliding"]
