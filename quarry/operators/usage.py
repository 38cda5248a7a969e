"""Usage, plans and limits, rate windows, jobs, conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.folds import folded

# Tokens and repositories by plan (-1: no limit), and the price a month.
PLANS = [("free", 40_000, 1, 0), ("plus", 1_000_000, 5, 19), ("pro", 4_000_000, -1, 60)]
# Requests per seconds by purpose, and the statuses of jobs.
RATE_LIMITS = {"chat": (20, 60), "indexation": (5, 60), "checkout": (10, 60), "default": (60, 60), "strict": (5, 300)}
IN_PROGRESS = ["pending", "fetching", "parsing", "embedding"]
TERMINAL = ["completed", "failed", "cancelled"]


def tokens_of(props: Column) -> Column:
    """The tokens of a usage event, from its JSON."""
    return F.get_json_object(props, "$.k").cast("long")


def totals(usage: DataFrame, by: list[Column] = ()) -> DataFrame:
    """Events and tokens, in all or by group; without rows a grand total is 0."""
    return usage.groupBy(*by).agg(F.count("*").alias("events"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def rollup(usage: DataFrame, first: str, second: str) -> DataFrame:
    """Grand total, totals by either column, in one scan: (level, key, events, tokens)."""
    sets = usage.groupingSets([[], [F.col(first)], [F.col(second)]], F.col(first), F.col(second))
    return sets.agg(
        F.count("*").alias("events"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.grouping_id().alias("g")
    ).select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, first).otherwise(second).alias("level"),
        F.coalesce(F.when(F.col("g") == 1, F.col(first).cast("string")), F.when(F.col("g") == 2, F.col(second).cast("string")), F.lit("")).alias("key"),
        "events", "tokens",
    )


def plans(spark) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, token_limit long, repo_limit long, price long")


def limits(accounts: DataFrame, usage: DataFrame, repos: DataFrame, plan_table: DataFrame) -> DataFrame:
    """Per account (user_id, plan, period_start): tokens of the period and repositories against the plan's limits.

    An unknown plan counts as free; a limit of 0 gives no percentage; -1 repositories is no limit.
    """
    known = plan_table.withColumnRenamed("plan", "known")
    a = accounts.join(F.broadcast(known), F.col("plan") == F.col("known"), "left")
    free = plan_table.filter("plan = 'free'").first()
    a = a.withColumns({c: F.coalesce(c, F.lit(free[c])) for c in ("token_limit", "repo_limit")}).withColumn("plan", F.coalesce("known", F.lit("free")))
    used = (
        usage.join(a.select("user_id", "period_start"), "user_id").filter(F.col("ts") >= F.col("period_start"))
        .groupBy("user_id").agg(F.sum("tokens").alias("tokens_used"))
    )
    owned = repos.groupBy("user_id").agg(F.count("*").alias("repos_used"))
    out = a.join(used, "user_id", "left").join(owned, "user_id", "left")
    tokens, owned_n = F.coalesce("tokens_used", F.lit(0)).cast("long"), F.coalesce("repos_used", F.lit(0)).cast("long")
    share = F.round(F.try_divide(F.lit(100.0) * F.col("tokens_used"), F.col("token_limit").cast("double")), 0)
    return out.withColumns({"tokens_used": tokens, "repos_used": owned_n}).select(
        "user_id", "plan", "tokens_used", "token_limit",
        F.greatest(F.col("token_limit") - F.col("tokens_used"), F.lit(0)).cast("long").alias("tokens_left"),
        F.least(share, F.lit(100.0)).cast("long").alias("percent"),
        (F.col("tokens_used") >= F.col("token_limit")).alias("tokens_reached"),
        "repos_used", "repo_limit", ((F.col("repo_limit") != -1) & (F.col("repos_used") >= F.col("repo_limit"))).alias("repos_reached"),
    )


def allowed(limits_: DataFrame, status: Column) -> DataFrame:
    """With may_chat and may_connect: an active account below the limit."""
    active = F.coalesce(status == "active", F.lit(False))
    return limits_.withColumns({"may_chat": active & ~F.col("tokens_reached"), "may_connect": active & ~F.col("repos_reached")})


def sliding_counts(requests: DataFrame, key: str, ts: str, limit: int, seconds: int) -> DataFrame:
    """Each request with the number of its key's requests in the seconds up to it (the lower edge left out, itself
    and refused ones included), and whether it is allowed."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    counted = requests.withColumn("_us", micros).withColumn("n_window", F.count("*").over(w))
    return counted.withColumn("allowed", F.col("n_window") <= limit).drop("_us")


def fixed_windows(requests: DataFrame, key: str, ts: str, limit: int, seconds: int, id_col: str) -> DataFrame:
    """Each request (key, id) with its place in a window that its key's first request opens and that lasts `seconds`;
    the first request after it has passed opens the next."""
    rows = requests.select(key, F.col(id_col).cast("long").alias(id_col), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))

    def start():
        reset, n = None, 0

        def place(us, _):
            nonlocal reset, n
            if reset is None or reset < us:
                reset, n = None if us is None else us + seconds * 1_000_000, 0
            n += 1
            return n

        return place

    placed = folded(rows, key, ["_us", id_col], start, "n_window", "long")
    return placed.drop("_us").withColumn("allowed", F.col("n_window") <= limit)


def latest(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def stale(jobs: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Jobs in progress whose start (or else creation) lies further back than that."""
    began = F.coalesce(F.col("started_at"), F.col("created_at"))
    return jobs.filter(F.col("status").isin(IN_PROGRESS) & (began < now - F.make_interval(mins=F.lit(minutes))))


# Where a phase begins on the overall scale, and how much of it it takes.
PHASES = {"Initializing": (0, 0), "Fetching files": (0, 10), "Parsing code": (10, 40), "Generating embeddings": (50, 45), "Finalizing": (95, 0)}


def phase_progress(phase: Column, done: Column, total: Column) -> Column:
    """Overall percentage for a share of a phase; an unknown phase is the whole scale, and without files it is 0."""
    share = F.try_divide(done.cast("double"), total.cast("double"))
    out = F.round(share * 100, 0)
    for name, (low, width) in PHASES.items():
        out = F.when(phase == name, low + F.round(share * width, 0)).otherwise(out)
    return F.least(F.greatest(F.coalesce(out, F.lit(0.0)), F.lit(0.0)), F.lit(100.0)).cast("int")


def status_class(status: Column) -> Column:
    return F.when(status.isin(IN_PROGRESS), "in_progress").when(status.isin(TERMINAL), "terminal").otherwise("unknown")


def conversation_list(parents: DataFrame, children: DataFrame, names: DataFrame, key: str, parent_key: str, name_key: str) -> DataFrame:
    """Parents with the number of their children (0 without any) and a name from a third table."""
    counts = children.groupBy(F.col(parent_key).alias(key)).agg(F.count("*").alias("n_children"))
    return parents.join(counts, key, "left").join(names, name_key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))


def last_n(messages: DataFrame, by: str, order: str, n: int = 10) -> DataFrame:
    """The newest n of each group, numbered from the oldest of them."""
    w = Window.partitionBy(by)
    newest = messages.withColumn("_d", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("_d") <= n).drop("_d")
    return newest.withColumn("place", F.row_number().over(w.orderBy(F.col(order))))


def unseen(new: DataFrame, history: DataFrame, content: str) -> DataFrame:
    """New messages whose content is in none of the history."""
    return new.join(history.select(content).distinct(), content, "left_anti")


def subscription_states(events: DataFrame, key: str, kind: str, order: str) -> DataFrame:
    """(key, status, plan) after all events of a subscription. created makes it, with its status (or active) and plan (or
    plus); while it is there, updated sets both, payment_failed makes it past_due, payment_succeeded makes a past_due one
    active, and deleted makes it free and canceled. Events of one that isn't there, not yet or no longer, change nothing.

    The last events that make it, end it, set the status and the plan, and the last payment, say it all, so no key's
    events are gathered. A subscription that is there has been made after it was last deleted, which set both."""
    k, row = F.col(kind), F.struct(F.col(order).alias("o"), F.col(kind).alias("kind"), F.col("plan"), F.col("status"))
    last = lambda which: F.max(F.when(which, row))
    found = events.groupBy(key).agg(
        last(k == "created").alias("made"),
        last(k == "deleted").alias("ended"),
        last(k.isin("created", "payment_failed") | ((k == "updated") & F.col("status").isNotNull())).alias("s"),
        last((k == "created") | ((k == "updated") & F.col("plan").isNotNull())).alias("p"),
        last(k == "payment_succeeded").alias("paid"),
    )
    status = F.when(F.col("s.kind") == "payment_failed", "past_due").otherwise(F.coalesce("s.status", F.lit("active")))
    status = F.when((status == "past_due") & F.coalesce(F.col("paid") > F.col("s"), F.lit(False)), "active").otherwise(status)
    never, over = F.col("made").isNull(), F.coalesce(F.col("ended") > F.col("made"), F.lit(False))
    return found.select(
        key, F.when(never, "none").when(over, "canceled").otherwise(status).alias("status"),
        F.when(never | over, "free").otherwise(F.coalesce("p.plan", F.lit("plus"))).alias("plan"),
    )


# Dollars per million tokens in and out.
PRICES = {"haiku": (0.25, 1.25), "chat": (3.0, 15.0)}


def routing_savings(routed: DataFrame, model: str, tokens_in: Column, tokens_out: Column) -> DataFrame:
    """One row: questions by model, and the percentage that routing saves against the larger model for all."""
    low, high = PRICES["haiku"], PRICES["chat"]
    small = F.col(model) == "haiku"
    cost = F.sum(F.when(small, tokens_in * low[0] + tokens_out * low[1]).otherwise(tokens_in * high[0] + tokens_out * high[1]))
    full = F.sum(tokens_in * high[0] + tokens_out * high[1])
    return routed.agg(
        F.count("*").alias("n"), F.count_if(small).alias("small_model"), F.count_if(~small).alias("large_model"),
        F.coalesce(F.round(F.try_divide((full - cost) * 100, full), 0), F.lit(0.0)).cast("long").alias("saved_percent"),
    )


def completed(before: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """Keys that were in progress at one look and are no more at the next; null keys don't count."""
    return before.select(key).filter(F.col(key).isNotNull()).distinct().join(now.select(key).distinct(), key, "left_anti")
