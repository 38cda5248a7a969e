"""Operators on small tables, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.operators import chunking, context, corpus, retrieval, usage
from quarry.sources import store

TS = """import { a } from './a'
const z = require('zed')

export async function first(x) {
  if (x) { return [1, 2, 3, 4, 5, 6].map((y) => y + x) } else { return null }
}

const tiny = () => { return 1 }

export class Second {
  method() { return "a text that is long enough to be kept here" }
}
export interface Third { name: string; other: number; more: boolean; last: Date }
"""
PY = "import os\nfrom a.b import c\n\ndef one(x):\n    y = x + 1\n    return [y for _ in range(100) if y > 10]\n\nclass Two:\n    def three(self):\n        return 'some text long enough to be a chunk'\n\nz = 1\n"


def test_rrf(spark):
    v = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, similarity double")
    t = spark.createDataFrame([(2, 5.0), (3, 4.0)], "id long, score double")
    got = {r["id"]: r["combined_score"] for r in retrieval.hybrid_rrf(v, t).collect()}
    assert {k: round(x, 9) for k, x in got.items()} == {2: round(1 / 62 + 1 / 61, 9), 1: round(1 / 61, 9), 3: round(1 / 62, 9)}
    w = {r["id"]: r["combined_score"] for r in retrieval.hybrid_weighted(v, t, 2).collect()}
    assert w == {2: round(0.7 * 0.8 + 0.3 * 5, 9), 3: 1.2}
    d = retrieval.diagnostics(retrieval.hybrid_rrf(v, t)).first()
    assert (d["n"], d["vector_only"], d["text_only"], d["in_both"]) == (3, 1, 1, 1)
    assert retrieval.diagnostics(retrieval.hybrid_rrf(v.filter("false"), t.filter("false"))).first()["avg_combined"] == 0


def test_text_search_needs_all_words(spark):
    docs = spark.createDataFrame([(1, "Alpha beta", None), (2, "alpha", "beta alpha"), (3, "alpha", None)], "id long, text string, name string")
    fields = {"name": (F.col("name"), "A"), "text": (F.col("text"), "C")}
    got = [r["id"] for r in retrieval.text_search(docs, "BETA, alpha!", fields).orderBy(F.desc("score")).collect()]
    assert got == [2, 1]
    assert retrieval.text_search(docs, " ?! ", fields).count() == 0


def test_dedupe_keeps_the_first_of_the_best(spark):
    rows = spark.createDataFrame([(1, 0.5, 0, "a"), (2, 0.9, 1, "b"), (1, 0.7, 2, "c"), (2, 0.9, 3, "d")], "id long, score double, ord long, x string")
    got = {r["id"]: (r["x"], r["first_ord"]) for r in retrieval.dedupe_best(rows, "ord").collect()}
    assert got == {1: ("c", 0), 2: ("b", 1)}


def test_rerank(spark):
    rows = spark.createDataFrame([(i, 1.0 / (i + 1), "red blue" if i % 2 else "red") for i in range(6)], "id long, score double, text string")
    score = retrieval.overlap_score("red blue", F.col("text"))
    assert [r["id"] for r in retrieval.rerank(rows, score, 3).collect()] == [1, 3, 5]
    few = retrieval.rerank(rows.limit(3), score)
    assert [r["score"] for r in few.collect()] == [r["original_score"] for r in few.collect()]
    doc = spark.range(1).select(retrieval.rerank_document(F.lit("function"), F.lit("f"), F.lit("a.ts"), F.lit(1), F.lit(2), F.lit("x"))).first()[0]
    assert doc == "function: f\nFile: a.ts:1-2\n\nx"


def test_recall(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 3)], "qid long, id long, rank int")
    relevant = spark.createDataFrame([(1, 11), (1, 12), (2, 20), (3, 30)], "qid long, id long")
    r = retrieval.recall_and_mrr(found, relevant, 10).first()
    assert (r["queries"], r["recall_at_k"], r["mrr"]) == (3, round((0.5 + 1 + 0) / 3, 6), round((1 / 2 + 1 / 3) / 3, 6))


def test_chunks_of_code():
    rows = chunking.chunk(TS, "src/a.ts")
    assert [(r[1], r[2], r[4], r[5]) for r in rows] == [(4, 6, "function", "first"), (10, 12, "class", "Second"), (13, 13, "interface", "Third")]
    assert rows[0][7] == ["./a", "zed"]
    rows = chunking.chunk(PY, "a.py")
    assert [(r[1], r[2], r[4], r[5]) for r in rows] == [(4, 7, "function", "one"), (8, 11, "class", "Two")]
    assert rows[0][7] == ["os", "a.b"]
    assert chunking.python_symbols(PY) == [("one", "function", 4, 6), ("Two", "class", 8, 10), ("three", "function", 9, 10)]
    assert chunking.chunk("  \n", "a.ts") == [] and chunking.chunk(None, "a.ts") == [] and chunking.python_symbols("def (") == []


def test_long_units_are_whole():
    """The last unit of a file is in its chunk to the end: by the syntax tree, by indentation, and with a brace left open."""
    body = "".join(f"    field_{i} = {i}\n" for i in range(200))
    tree = f'"""A text.\ndef not_one(of, the, units): it stands in a string, though it is long.\n"""\n@one\n@two(\n    3)\nclass Last(\n):\n{body}'
    (row,) = chunking.chunk(tree, "a.py")
    assert row[1:3] == (4, 209) and row[4:6] == ("class", "Last") and row[6] == "\n".join(tree.split("\n")[3:])
    assert chunking.chunk("\ufeff" + tree, "a.py")[0][1:] == row[1:]
    (row,) = chunking.chunk(f"class Last:\n{body}    print 'old'\n", "a.py")
    assert row[1:3] == (1, 203) and "field_199" in row[6] and "print 'old'" in row[6]
    (row,) = chunking.chunk("class Last {\n" + "  call()\n" * 200 + "  end()\n", "a.ts")
    assert row[1:3] == (1, 203) and "end()" in row[6]
    (row,) = chunking.chunk("class Last:\r    x = 1\n" + body, "a.py")
    assert row[1] == 1 and "field_199" in row[6]


def test_long_class_is_indexed(spark):
    content = "class Last:\n" + "".join(f"    field_{i} = {i}\n" for i in range(200))
    rows = chunking.chunk_files(spark.createDataFrame([("a.py", content)], "path string, content string")).collect()
    assert [r["content"] for r in rows] == [content]


def test_chunks_of_text():
    lines = [f"line {i} " + "x" * 90 for i in range(100)]
    rows = chunking.chunk("\n".join(lines), "notes.txt")
    assert all(len(r[6]) <= chunking.MOST and r[6] == "\n".join(lines[r[1] - 1 : r[2]]) for r in rows)
    assert rows[0][1] == 1 and rows[-1][2] == 100 and all(b[1] == a[2] - 1 for a, b in zip(rows, rows[1:], strict=False))
    models = "model A {\n  id Int\n}\n\nmodel B {\n  id Int\n  x String\n}\n"
    assert [(r[5], r[1], r[2]) for r in chunking.chunk(models, "p/schema.prisma")] == [("A", 1, 3), ("B", 5, 8)]
    assert chunking.chunk('{"a": 1}', "package.json")[0][4:6] == ("config", "package.json")


def test_chunk_files_and_scopes(spark):
    files = spark.createDataFrame([("src/a.ts", TS), ("a.py", PY), ("e.ts", None), (None, "x"), ("b.txt", "short")], "path string, content string")
    assert chunking.chunk_files(files).count() == 5
    assert chunking.chunk_files(files.filter("false")).count() == 0
    places = spark.createDataFrame([("a.py", 10), ("a.py", 5), ("a.py", 12)], "path string, line int")
    got = {r["line"]: (r["class_name"], r["function_name"]) for r in chunking.enclosing(chunking.symbols(files), places).collect()}
    assert got == {10: ("Two", "three"), 5: (None, "one"), 12: (None, None)}


def test_dependencies(spark):
    deps = spark.createDataFrame([("typescript", TS), ("python", PY), ("go", 'import (\n "fmt"'), ("text", TS), (None, None)], "l string, c string")
    got = {r["l"]: r["d"] for r in deps.select("l", corpus.dependencies(F.col("c"), F.col("l")).alias("d")).collect()}
    assert got == {"typescript": ["./a", "zed"], "python": ["os", "a.b"], "go": ["fmt"], "text": [], None: []}


def plain_priorities(files, most):
    """Files of one repository that are kept, by the greedy rule."""
    lines = lambda s: -(-s // 40)
    if lines(sum(s for _, s in files)) <= most:
        return sorted(files)
    rest = [f for f in files if "lib" in f[0].split("/") or f[0].endswith("package.json")]
    if lines(sum(s for _, s in rest)) <= most:
        return sorted(rest)
    used, kept = 0, []
    for f in sorted(rest, key=lambda f: (not f[0].endswith("package.json"), f[0])):
        if used + lines(f[1]) <= most:
            used += lines(f[1])
            kept.append(f)
    return sorted(kept)


def test_priorities(spark):
    rng = random.Random(1)
    rows = [(f"r{r}", rng.choice(["lib/", "x/", "y/lib/"]) + rng.choice([f"f{i}.ts", f"g{i}.py", f"{i}/package.json"]), rng.randrange(1, 4000)) for r in range(6) for i in range(5 + 8 * r)]
    got = defaultdict(list)
    for r in corpus.prioritised(spark.createDataFrame(rows, "repo string, path string, size long"), "repo", 300).collect():
        got[r["repo"]].append((r["path"], r["size"]))
    for repo in {r[0] for r in rows}:
        assert sorted(got[repo]) == plain_priorities([f[1:] for f in rows if f[0] == repo], 300), repo


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate([40, 30, 50, 5])], "i long, n long")
    assert [r["i"] for r in context.prefix_pack(rows, 100, "n", [F.col("i")]).collect()] == [0, 1]


def test_citations(spark):
    texts = ["a [x/y.ts:3-9] b [x/z.py] é [q/r.go:4](u) [word] [a/(b)/c.tsx:1]", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = [(r["path"], r["line"], r["end_line"]) for r in context.citations(rows, "t").orderBy("n").collect()]
    assert got == [("x/y.ts", 3, 9), ("x/z.py", None, None), ("a/(b)/c.tsx", 1, None)]
    assert all(texts[0][r["start_index"] : r["end_index"]] == r["original"] for r in context.citations(rows, "t").collect())
    pieces = context.segments(rows.filter("id = 0"), "t").orderBy("n").collect()
    assert "".join(p["piece"] for p in pieces) == texts[0] and [p["piece"] for p in pieces if p["is_citation"]][0] == "[x/y.ts:3-9]"


def test_formats(spark):
    f = lambda *more, **kw: context.format_chunk(F.lit("a.ts"), F.lit(1), F.lit(2), F.lit("function"), *more, F.lit("ts"), F.lit("code"), **kw)
    r = spark.range(1).select(f(F.lit("s"), score=F.lit(0.456)).alias("a"), f(F.lit(None).cast("string"), context=F.lit("why")).alias("b"), context.enriched(F.lit(" "), F.lit("x")).alias("c")).first()
    assert r["a"] == "### [a.ts:1-2]\n**function**: `s`\n_Relevance: 46%_\n\n```ts\ncode\n```\n"
    assert r["b"] == "### [a.ts:1-2]\n\n> why\n\n```ts\ncode\n```\n" and r["c"] == "x"


def test_fixed_windows(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(400)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = {}
    for user in range(3):
        reset, n = None, 0
        for s, i in sorted((s, i) for i, u, s in rows if u == user):
            if reset is None or reset < s:
                reset, n = s + 30, 0
            n += 1
            want[i] = (n, n <= 4)
    got = {r["event_id"]: (r["n_window"], r["allowed"]) for r in usage.fixed_windows(df, "user_id", "ts", 4, 30, "event_id").collect()}
    assert got == want


def gathers(df):
    return "collect_list" in df._jdf.queryExecution().optimizedPlan().toString()


def test_no_key_is_gathered_in_one_row(spark):
    """One user or repository may hold all rows: batches of a few rows give what one batch gives."""
    rows = spark.range(5000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 50 > 0, 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 7 % 5003).alias("ts"),
        F.lit("r").alias("repo"), F.concat(F.lit("lib/f"), F.col("id"), F.lit(".py")).alias("path"), (F.col("id") % 4000 + 1).alias("size"),
        F.lit("payment_failed").alias("kind"), F.lit("x").alias("plan"), F.lit("y").alias("status"),
    )
    made = lambda: [
        usage.fixed_windows(rows, "user_id", "ts", 5, 100, "event_id"), corpus.prioritised(rows, "repo", 2000),
        usage.subscription_states(rows, "user_id", "kind", "event_id"),
    ]
    assert not any(gathers(df) for df in made())
    whole = [sorted(map(str, df.collect())) for df in made()]
    assert [len(x) for x in whole][::2] == [5000, 2] and len(whole[1]) > 50
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [sorted(map(str, df.collect())) for df in made()] == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_large_repository_is_not_split(spark):
    """Where a join splits the rows of one repository over tasks, they are still packed together."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 100 > 0, "r").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("repo"), F.concat(F.lit("lib/f"), F.col("id"), F.lit(".py")).alias("path"),
        (F.col("id") % 4000 + 1).alias("size"),
    )
    prefix = "spark.sql.adaptive."
    small = {"skewJoin.skewedPartitionThresholdInBytes": "1k", "advisoryPartitionSizeInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.1", "coalescePartitions.enabled": "false", "autoBroadcastJoinThreshold": "-1"}
    conf = {f"{prefix}{k}": v for k, v in small.items()} | {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        kept = corpus.prioritised(rows.repartition(20), "repo", 2000).filter("repo = 'r'").agg(F.sum(P.lines_of(F.col("size"))), F.count("*")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert kept[0] <= 2000 and kept[1] > 10


def test_subscriptions_against_fold(spark):
    rng = random.Random(8)
    kinds = ["created", "updated", "payment_failed", "payment_succeeded", "deleted", "other", None]
    rows = [(k, rng.choice([None, *range(20)]), rng.choice(kinds), rng.choice([None, "plus", "pro"]), rng.choice([None, "active", "past_due"])) for k in range(150) for _ in range(k % 12)]
    low = lambda row: tuple((x is not None, x) if x is not None else (False, 0) for x in row[1:])
    want = {}
    for k, _, kind, plan, status in sorted(rows, key=lambda row: (row[0], low(row))):
        s, p = want.get(k, ("none", "free"))
        there = s not in ("none", "canceled")
        if kind == "created":
            s, p = status or "active", plan or "plus"
        elif there and kind == "updated":
            s, p = status or s, plan or p
        elif there and (kind == "payment_failed" or (kind == "payment_succeeded" and s == "past_due")):
            s = "past_due" if kind == "payment_failed" else "active"
        elif there and kind == "deleted":
            s, p = "canceled", "free"
        want[k] = (s, p)
    df = spark.createDataFrame(rows, "id long, o long, kind string, plan string, status string")
    assert {r["id"]: (r["status"], r["plan"]) for r in usage.subscription_states(df, "id", "kind", "o").collect()} == want


def test_sliding_window_edge(spark):
    df = spark.createDataFrame([(1, 0), (1, 59), (1, 60), (1, 60)], "k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(r["n_window"] for r in usage.sliding_counts(df, "k", "ts", 2, 60).collect())
    assert got == [1, 2, 3, 3]  # the request at 0 has left the window of those at 60


def test_subscriptions(spark):
    events = [(1, "created", "pro", "active"), (2, "payment_failed", None, None), (3, "payment_succeeded", None, None), (4, "deleted", None, None), (5, "payment_succeeded", None, None), (6, "updated", "plus", None)]
    df = spark.createDataFrame(events, "o long, kind string, plan string, status string").withColumn("id", F.lit(1))
    want = [("active", "pro"), ("past_due", "pro"), ("active", "pro"), ("canceled", "free"), ("canceled", "free"), ("canceled", "free")]
    for n, w in enumerate(want, 1):
        r = usage.subscription_states(df.filter(F.col("o") <= n), "id", "kind", "o").first()
        assert (r["status"], r["plan"]) == w


def test_rerank_metrics(spark):
    before = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("e", 0.5)], "id string, score double")
    after = spark.createDataFrame([("e", 5.0), ("d", 4.0), ("a", 3.0), ("x", 2.0)], "id string, score double")
    r = retrieval.rerank_metrics(retrieval.rank_changes(before, after)).first()
    assert tuple(r) == (-1.0, 3, 4, "e:4:0,d:3:1")  # changes -4, -2, 2, and none for x
    assert tuple(retrieval.rerank_metrics(retrieval.rank_changes(before, after.filter("false"))).first()) == (0.0, 0, 0, "")


def test_search_without_a_query_vector(spark):
    rows = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    assert retrieval.knn(rows, None).count() == 0


def test_limits(spark):
    accounts = spark.createDataFrame([(1, "free"), (2, "pro"), (3, "odd")], "user_id long, plan string").withColumn("period_start", F.to_timestamp(F.lit("2024-01-01")))
    used = spark.createDataFrame([(1, 40_000), (2, 1), (2, 2)], "user_id long, tokens long").withColumn("ts", F.to_timestamp(F.lit("2024-01-02")))
    repos = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    got = {r["user_id"]: r for r in usage.allowed(usage.limits(accounts, used, repos, usage.plans(spark)), F.lit("active")).collect()}
    assert got[1]["tokens_reached"] and got[1]["percent"] == 100 and got[1]["repos_reached"] and not got[1]["may_chat"]
    assert got[2]["may_chat"] and got[2]["may_connect"] and got[3]["plan"] == "free" and got[3]["tokens_left"] == 40_000


def test_writes(spark, tmp_path):
    path = str(tmp_path / "chunks")
    old = spark.createDataFrame([(1, "a", "r1"), (2, "b", "r2")], "id long, x string, repo string")
    store.append(old, path, "repo")
    store.replace_partitions(spark.createDataFrame([(3, "c", "r1"), (4, "d", "r1")], old.schema), path, "repo")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3, 4]
    new = spark.createDataFrame([(2, None, "r9"), (5, "e", "r5")], old.schema)
    got = {r["id"]: (r["x"], r["repo"]) for r in store.upserted(old, new, ["id"], only_given=True).collect()}
    assert got == {1: ("a", "r1"), 2: ("b", "r9"), 5: ("e", "r5")}
    assert sorted(r["id"] for r in store.without(old, F.col("x") == "a").collect()) == [2]
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "é.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.ts").write_text("let y\n")
    files = store.list_files(spark, str(tmp_path / "src"))
    assert [r["size"] for r in files.collect()] == [6, 6] and store.structure(files).first()["lines"] == 1
    assert {r["content"] for r in store.read_files(spark, str(tmp_path / "src")).collect()} == {"x = 1\n", "let y\n"}


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha string")
    assert {r["path"]: r["change"] for r in corpus.snapshot_diff(old, new).collect()} == {"b": "modified", "c": "deleted", "d": "added"}


@pytest.mark.parametrize("phase,done,total,want", [("Fetching files", 5, 10, 5), ("Parsing code", 5, 10, 30), ("Finalizing", 1, 1, 95), ("Other", 3, 4, 75), ("Parsing code", 1, 0, 0), ("Other", 9, 4, 100)])
def test_progress(spark, phase, done, total, want):
    assert spark.range(1).select(usage.phase_progress(F.lit(phase), F.lit(done), F.lit(total))).first()[0] == want


@pytest.mark.parametrize("repeated", [False, True])
def test_size_of_postings(spark, repeated):
    """Counted as the postings themselves count; a row's words are not shuffled with their id, but those of ids that repeat."""
    rows = [(1, "a", "B b c"), (2, "a b", ""), (3, None, "c C \u00c9"), (4, None, None)] + [(1, "a", "c d"), (None, "a", "x"), (None, "a", "x")] * repeated
    docs = spark.createDataFrame(rows, "id long, name string, text string")
    fields = {"name": (F.col("name"), "A"), "title": (F.upper("name"), "A"), "text": (F.col("text"), "C")}
    postings = retrieval.postings(docs, fields)
    want = postings.groupBy("w").agg(F.count("*"), F.sum("tf"), F.countDistinct("tok")).collect()
    found = retrieval.postings_size(docs, fields)
    assert found.columns == ["w", "postings", "occurrences", "terms"] and sorted(map(tuple, found.collect())) == sorted(map(tuple, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == repeated and not any("id#" in line for line in plan.split("\n") if "Aggregate" in line)
    assert retrieval.postings_size(docs.filter("false"), fields).count() == 0
