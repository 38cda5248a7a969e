"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Every row has a 63-bit hash of its id, source and text. Per source, the words are summed by hash bucket (the
top bits); the running sum names the bucket in which the source's budget ends. Only the rows of that boundary
bucket are summed again by their next bits, until it holds at most `FOLD` rows; a fold takes of those, in hash
order, what still fits. The choice is then a filter, hash < threshold or hash among the few of the last bucket:
nothing is sorted, a larger budget of the same source takes a superset up to that bucket, and reruns agree.

Scale: the texts are read once, into a narrow table (id, source, size, hash) in the checkpoint folder. Each
level is one partially aggregated sum over it (at most 512 rows per source and task leave a task), so a hot
source costs no more shuffle than others. The driver holds one state row per source (with at most FOLD hashes).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, fresh
from ._graph import salted

BITS, FOLD = 9, 256
#: A hash in the bucket that begins at lo and is 2 ** width wide (63: all).
INSIDE = "shiftright(hash, width) = shiftright(lo, width)"
WORDS = r"[^\x20\x09-\x0D]+"
#: State is broadcast up to this size; beyond it, it joins by shuffle, a source's rows being dealt to several tasks.
BROADCAST_BYTES = 32 << 20


def targets(sizes: dict, weights=(1, 2, 3), most: float = 3.0) -> dict:
    """Target words per source, by code point, null last, with the weights repeating.

    They share the sum of all sizes; a target stops at `most` times its source's size, and what is over is
    shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in free}
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def _with_state(rows: DataFrame, states: list[tuple], schema: str, source: Column) -> DataFrame:
    """`rows` with the columns of the state (source first in `states` and `schema`) of their source."""
    state = rows.sparkSession.createDataFrame(states, schema)
    name = state.columns[0]
    size = sum(100 + 16 * sum(len(x) for x in s if isinstance(x, list)) for s in states)
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(state), source.eqNullSafe(F.col(name))).drop(name)
    (key,) = fresh(rows, "key")
    told = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("none"))
    state = state.withColumn(key, told(F.col(name))).drop(name)
    return salted(rows.withColumn(key, told(source)), state, key, F.monotonically_increasing_id()).drop(key)


def _refined(sized: DataFrame, budgets: dict, rows: dict) -> dict:
    """Per source: where its boundary bucket begins and how wide it is (log2), and the budget left in it.

    Buckets are as narrow as it takes to leave about FOLD / 2 of the `rows` in one, 2 ** BITS of them at most."""
    state = {s: (0, 63, b) for s, b in budgets.items()}
    active = {s: rows[s] for s in budgets if rows[s] > FOLD}
    while active:
        asked = []
        for s, n in active.items():
            lo, width, left = state[s]
            asked.append((s, lo, width, max(0, width - min(BITS, math.ceil(math.log2(2 * n / FOLD)))), left))
        inside = _with_state(sized, asked, "state_source string, lo long, width int, next int, left double", F.col("source")).filter(INSIDE)
        sums = inside.groupBy("source", F.expr("shiftright(hash, next)").alias("bucket"), "next", "left").agg(
            F.sum("size").alias("words"), F.count("*").alias("n")
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        ends = (
            sums.withColumn("upto", upto)
            .filter("upto > left")
            .groupBy("source", "next", "left")
            .agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("b"))
            .collect()
        )
        ended = {r["source"]: r for r in ends}
        for s in list(active):
            if s not in ended:  # the budget takes all that is there
                state[s] = (state[s][0] + (1 << state[s][1]) - 1, 0, 0.0)
                del active[s]
                continue
            r = ended[s]
            state[s] = (r["b"]["bucket"] << r["next"], r["next"], r["left"] - (r["b"]["upto"] - r["b"]["words"]))
            active[s] = r["b"]["n"]
            if r["b"]["n"] <= FOLD or r["next"] == 0:
                del active[s]
    return state


def _folded(sized: DataFrame, state: dict) -> dict:
    """Per source, what of its boundary bucket is taken: [(hash, rows taken of it, rows that there are)]."""
    rows = _with_state(sized, [(s, *x) for s, x in state.items()], "state_source string, lo long, width int, left double", F.col("source"))
    same = (
        rows.filter(INSIDE)
        .groupBy("source", "hash", "size", "left")
        .agg(F.count("*").alias("n"))
    )
    taken = F.aggregate(
        F.array_sort(F.collect_list(F.struct("hash", "size", "n"))),
        F.struct(F.first("left").alias("left"), F.expr("cast(array() as array<struct<hash: bigint, rows: bigint, n: bigint>>)").alias("took")),
        lambda a, x: F.struct(
            (a["left"] - x["size"] * _fits(a, x)).alias("left"),
            F.when(_fits(a, x) > 0, F.concat(a["took"], F.array(F.struct(x["hash"].alias("hash"), _fits(a, x).alias("rows"), x["n"].alias("n")))))
            .otherwise(a["took"])
            .alias("took"),
        ),
        lambda a: a["took"],
    )
    out = same.groupBy("source").agg(taken.alias("took")).collect()
    return {r["source"]: [(x["hash"], x["rows"], x["n"]) for x in r["took"]] for r in out}


def _fits(a, x):
    """How many of x's like rows fit into what is left."""
    each = F.when(x["size"] > 0, F.floor(a["left"] / x["size"])).otherwise(x["n"])
    return F.greatest(F.lit(0).cast("long"), F.least(x["n"], each))


def mix(
    docs: DataFrame,
    weights=(1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """Each row with its size in words, its source's size and target, and the words that the mix takes of it.

    Returns id, size, source_size, target, taken (`keep`: all columns of `docs` before these four, under names
    that don't clash). A row is taken floor(target / source_size) times, and once more if it is chosen; so none is
    taken more than `most` times. A null text has size 0 and is taken 0 words; a null source is a source of its
    own, the last; null ids are like any other. Of like rows (same id, source and text) the mix may take some
    only. A source without words has target 0. An empty table gives no rows.
    """
    size, hashed, row = fresh(docs, "size", "hash", "row")
    if keep:
        rows = docs.withColumn(size, F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long"))
        columns = docs.columns
    else:
        rows = docs.select(F.col(id_col), F.col(source_col), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias(size), F.col(text_col))
        columns = [id_col]
    rows = rows.withColumn(hashed, F.shiftrightunsigned(F.xxhash64(id_col, source_col, text_col), 1))
    if not keep:
        rows = cut(rows.drop(text_col))
    sized = rows.select(F.col(source_col).cast("string").alias("source"), F.col(size).alias("size"), F.col(hashed).alias("hash"))
    if keep:
        sized = cut(sized)
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()
    sizes, counts = {r["source"]: r["words"] for r in totals}, {r["source"]: r["n"] for r in totals}
    target = targets(sizes, weights, most)
    times = {s: min(most, int(target[s] // n)) if n else 0 for s, n in sizes.items()}
    state = _refined(sized, {s: float(target[s] - times[s] * n) for s, n in sizes.items()}, counts)
    took = _folded(sized, state)
    states = [
        (s, n, target[s], times[s], state[s][0], [x[0] for x in took.get(s, [])], [x[1] for x in took.get(s, [])])
        for s, n in sizes.items()
    ]
    names = fresh(docs, "source_size", "target", "times", "below", "whole", "some", "state_source")
    s_size, s_target, s_times, s_below, s_hashes, s_counts, s_source = names
    schema = f"`{s_source}` string, `{s_size}` long, `{s_target}` double, `{s_times}` int, `{s_below}` long, `{s_hashes}` array<long>, `{s_counts}` array<long>"
    joined = _with_state(rows, states, schema, F.col(source_col).cast("string"))
    # like rows of the last bucket: so many of them as were counted; an index within the like rows of one task's
    # share, since any of them stands for the others
    place = F.array_position(s_hashes, F.col(hashed)).cast("int")
    counted = F.when(place > 0, F.element_at(s_counts, F.when(place > 0, place).otherwise(F.lit(1))))
    extra = F.when(F.col(hashed) < F.col(s_below), F.lit(1).cast("long")).otherwise(F.coalesce(counted, F.lit(0).cast("long")))
    joined = joined.withColumn(row, extra)
    partly = [h for x in took.values() for h, k, n in x if k < n]
    chosen = F.least(F.col(row), F.lit(1).cast("long"))
    if partly:
        chosen = F.when(F.col(hashed).isin(partly), F.lit(None).cast("long")).otherwise(chosen)
        some = _numbered(joined.filter(F.col(hashed).isin(partly)), hashed, row)
        joined = joined.filter(~F.col(hashed).isin(partly)).withColumn(row, chosen).unionByName(some)
    else:
        joined = joined.withColumn(row, chosen)
    taken = (F.col(size) * (F.col(s_times) + F.col(row))).cast("long")
    (t,) = fresh(docs, "taken")
    return joined.select(*[F.col(c) for c in columns], size, s_size, s_target, taken.alias(t))


def _numbered(rows: DataFrame, hashed: str, wanted: str) -> DataFrame:
    """1 in `wanted` for as many like rows as it says, else 0. Rows are numbered within a task's share, and the
    shares' counts are summed before, so that like rows are never brought together. The rows are written with their
    share, since both readings of them must have the same."""
    share, n, before = fresh(rows, "share", "n", "before")
    rows = cut(rows.withColumn(share, F.spark_partition_id()))
    counts = rows.groupBy(hashed, share).agg(F.count("*").alias(n))
    offsets = counts.withColumn(
        before, F.coalesce(F.sum(n).over(Window.partitionBy(hashed).orderBy(share).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop(n)
    index = F.row_number().over(Window.partitionBy(hashed, share).orderBy(F.lit(1)))
    return (
        rows.withColumn(n, index)
        .join(offsets, [hashed, share])
        .withColumn(wanted, (F.col(n) + F.col(before) <= F.col(wanted)).cast("long"))
        .drop(share, n, before)
    )
