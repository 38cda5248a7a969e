"""Chat formatting against recursion over the same trees, and exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat, queries

SCHEMA = "tree long, id long, parent long, role string, text string, score double"


def plain_paths(rows):
    """{(tree, branch): [(role, text)]} by recursion."""
    out = {}
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        up = lambda r: own.get(r[2])
        leaves = [r for r in own.values() if not any(o[2] == r[1] for o in own.values())]
        paths = []
        for leaf in leaves:
            path, at = [], leaf
            while at is not None:
                path.append(at)
                at = up(at)
            paths.append((-sum(r[5] or 0 for r in path) / len(path), leaf[1], path[::-1]))
        for n, (_, _, path) in enumerate(sorted(paths, key=lambda p: p[:2]), 1):
            out[tree, n] = [(r[3] or "", r[4] or "") for r in path]
    return out


def formatted(spark, rows, branches=None):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit("other"))
    out = chat.format_trees(df, branches)
    back = out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.under_loss(F.col("formatted"), F.col("loss_spans")))
    return {(r["tree"], r["branch"]): r for r in back.collect()}


def test_trees(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b</s>", 2.0), (1, 4, 3, "user", None, 0.0),
        (1, 5, 4, "assistant", "d\\", 5.0), (1, 6, 4, None, "e", 5.0), (2, 1, None, "user", "x", None), (None, 1, 99, "user", "z", 0.0),
        *[(3, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}[INST]", 0.0) for i in range(37)],
    ]
    want, got = plain_paths(rows), formatted(spark, rows)
    assert set(want) == set(got)
    for key, path in want.items():
        assert [(t["role"], t["text"]) for t in got[key]["turns"]] == path
        assert got[key]["learnt"] == "".join(t for r, t in path if r == "assistant") and got[key]["n_turns"] == len(path)
    best = formatted(spark, rows, 1)
    assert {k: [(t["role"], t["text"]) for t in v["turns"]] for k, v in best.items()} == {k: v for k, v in want.items() if k[1] == 1}


def test_circles_end(spark):
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (2, 1, None, "user", "c", 0.0)]
    assert (2, 1) in formatted(spark, rows)


def test_empty(spark):
    assert chat.format_trees(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=1, deadline=None)
@given(st.data())
def test_escape(spark, data):
    pieces = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "\\\\", "a", " ", "$1", "\n", "é", "|"]), max_size=12).map("".join)
    texts = data.draw(st.lists(pieces, min_size=300, max_size=300))
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


def test_query(spark, medium):
    rows = spark.read.parquet(f"{medium}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    talks = {}
    for c, _, role, text in sorted(map(tuple, rows), key=lambda r: r[:2]):
        talks.setdefault(c, []).append((role or "", text or ""))
    talks[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in queries.op3_chat_formatting(spark, medium).collect()}
    assert set(got) == set(talks)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in talks.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
