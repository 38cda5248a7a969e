"""Chat formatting of reply trees. DataFrame functions only.

Messages (tree, id, parent, role, text, score) form trees. Self-joins enumerate the root-to-leaf paths by
doubling: after round i every message knows its ancestor 2 ** i up, so log2(depth) rounds reach every root,
and the rows of a chosen path double per round in the same way. Branches rank by the mean score of their
messages; the best `branches` of each tree are formatted, each as one conversation.

Template: each turn is TURN role TEXT text END. Whatever begins like a control string inside a role or text gets a
backslash after its first character, and a backslash is doubled, so that no control string stands inside a text
and the texts can be read back exactly. Loss spans (code points) cover the assistant's texts as they stand there.

Scale: jumps are narrow rows (no texts) that shuffle by (tree, message), so a tree with a third of all messages
spreads over all tasks; texts join once, to the rows of the chosen paths. Lineage is cut by checkpoint() in each
round. What is gathered in one row is one formatted conversation, which is the result itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that mean something to this template or to common tokenizers.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>", "<unk>")
_AHEAD = "|".join(sorted("\\Q" + c[1:] + "\\E" for c in CONTROL))
_BEGINS = "".join(sorted({"\\" + c[0] for c in CONTROL}))
_START = f"([{_BEGINS}])(?={_AHEAD})"


def escape(text: Column) -> Column:
    """Text in which no control string stands; null is empty."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _START, r"$1\\")


def unescape(text: Column) -> Column:
    """What `escape` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """[messages with their ancestor 1 up, 2 up, 4 up, ...] as (tree, id, up), roots left out."""
    n = nodes.count()
    jump = cut(nodes.filter("parent is not null").select("tree", "id", F.col("parent").alias("up")))
    out = []
    while not jump.isEmpty():
        out.append(jump)
        if 2 ** len(out) > n:  # longer than any path: what is left goes round in a circle
            break
        further = jump.select(F.col("tree").alias("t"), F.col("id").alias("up"), F.col("up").alias("up2"))
        jump = cut(
            jump.join(further, F.col("tree").eqNullSafe(F.col("t")) & (jump["up"] == further["up"]))
            .select("tree", "id", F.col("up2").alias("up"))
        )
    return out


def paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, branch, step, id): the messages of the best root-to-leaf paths, step counting from the leaf (0).

    `nodes`: tree, id, parent, score. branch 1 is the leaf whose path has the highest mean score, ties to the
    smaller id; null `branches` keeps all. Messages that form a circle have no leaf below which they count, or
    give a path that ends where it has gone round.
    """
    jumps = _jumps(nodes)
    parents = nodes.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = nodes.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("p")), "left_anti")
    # sums of scores from a message up, over 1, 2, 4, ... messages; s: sum, k: messages, at: where to go on
    reach = nodes.select("tree", "id", F.col("score").alias("s"), F.lit(1).alias("k"), F.col("parent").alias("at"))
    for _ in jumps:
        up = reach.select(F.col("tree").alias("t"), F.col("id").alias("i"), F.col("s").alias("s2"), F.col("k").alias("k2"), F.col("at").alias("at2"))
        going, done = reach.filter("at is not null"), reach.filter("at is null")  # at the root a sum is complete
        further = going.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("i")), "left").select(
            "tree", "id", (F.col("s") + F.coalesce("s2", F.lit(0.0))).alias("s"), (F.col("k") + F.coalesce("k2", F.lit(0))).alias("k"), F.col("at2").alias("at")
        )
        reach = cut(done.unionByName(further))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("s") / F.col("k")), "id"))
    scored = leaves.select("tree", "id").join(
        reach.select(F.col("tree").alias("t"), F.col("id").alias("i"), "s", "k"),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")),
    )
    ranked = scored.withColumn("branch", rank)
    chosen = ranked if branches is None else ranked.filter(F.col("branch") <= branches)
    on_path = chosen.select("tree", "branch", F.lit(0).alias("step"), "id")
    for i, jump in enumerate(jumps):
        up = jump.select(F.col("tree").alias("t"), F.col("id").alias("i"), "up")
        higher = on_path.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i"))).select(
            "tree", "branch", (F.col("step") + 2**i).alias("step"), F.col("up").alias("id")
        )
        on_path = cut(on_path.unionByName(higher))
    return on_path


def format_trees(messages: DataFrame, branches: int | None = 1, learn_from: str = "assistant") -> DataFrame:
    """tree, branch, n_turns, formatted, loss_spans (array of start, end: code points, end exclusive).

    `messages`: tree, id (unique within the tree, not null), parent, role, text, score; other columns are ignored.
    Null roles and texts are empty ones; a parent that isn't there makes a message a root; a null tree is a tree
    of its own; null scores count 0. An empty table gives no rows.
    """
    rows = messages.select(
        "tree", F.col("id").cast("long"), F.col("parent").cast("long"), "role", "text",
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    known = rows.select(F.col("tree").alias("t"), F.col("id").alias("i")).distinct()
    linked = rows.select("tree", "id", "parent", "score").join(
        known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("i")), "left"
    )
    nodes = cut(linked.select("tree", "id", F.col("i").alias("parent"), "score"))
    steps = paths(nodes, branches).select(F.col("tree").alias("t"), "branch", "step", F.col("id").alias("i"))
    turns = rows.join(steps, F.col("tree").eqNullSafe(F.col("t")) & (F.col("id") == F.col("i")))
    told = turns.select(
        "tree", "branch", "step", F.coalesce("role", F.lit("")).alias("role"),
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"), escape(F.col("text")).alias("body"),
    )
    ordered = told.groupBy("tree", "branch").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("at"), "head", "body", "role"))).alias("turns")
    )
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))
    spans = F.aggregate(
        "turns", begin,
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END)).cast("long").alias("at"),
            F.when(
                x["role"] == learn_from,
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).cast("long").alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).cast("long").alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return ordered.select(
        "tree", "branch", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, "\\Q" + TURN + "\\E", -1), lambda p, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, TEXT, 1)).alias("role"),
            unescape(F.regexp_replace(F.regexp_replace(p, "(?s)^.*?\\Q" + TEXT + "\\E", ""), "\\Q" + END + "\\E$", "")).alias("text"),
        ),
    )


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


def by_turn(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text): each answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("id"), "role", "text"
    )
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select("tree", "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
