"""The stored lexical index, strategies, whole contexts and reranking by a provider, on small tables."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import context, lexical, retrieval, strategies
from quarry.streaming.windows import shared_folder

DOCS = "id long, name string, text string"


@pytest.fixture
def fields(spark):
    return {"name": (F.col("name"), "A"), "text": (F.col("text"), "C")}


ROWS = [(1, "Alpha beta", None), (2, "alpha", "beta alpha É"), (3, "alpha", None), (4, None, None), (5, "", "É beta")]
ASKED = ("alpha", "BETA, alpha!", "é", "missing", "alpha missing", " ?! ")


def same(spark, path, docs, fields, queries=ASKED):
    """What the index at a path finds is what a scan of `docs` finds."""
    for query in queries:
        want = sorted(map(tuple, retrieval.text_search(docs, query, fields).collect()))
        assert sorted(map(tuple, lexical.search(spark, path, query).collect())) == want, query
        ranked = dict(map(tuple, lexical.bm25(spark, path, query, "C").collect()))
        true = dict(map(tuple, retrieval.bm25(docs, query, F.col("text")).collect()))
        assert ranked == pytest.approx(true), query
    best = sorted(want, key=lambda r: (-r[1], r[0]))[:2]
    assert sorted(map(tuple, lexical.search(spark, path, query, 2).collect())) == sorted(best), query
    found = lexical.bm25(spark, path, query, "C", k=2).collect()
    assert [r["id"] for r in sorted(found, key=lambda r: (-r["score"], r["id"]))] == sorted(true, key=lambda i: (-true[i], i))[:2]


def test_stored_index_finds_what_a_scan_finds(spark, tmp_path, fields, monkeypatch):
    monkeypatch.setattr(lexical, "FOLDER_WORDS", 3)
    docs, path = spark.createDataFrame(ROWS, DOCS), f"{tmp_path}/i"
    lexical.write(docs.limit(3), fields, path)
    lexical.write(docs.filter("id > 3"), fields, path, mode="append")
    same(spark, path, docs, fields)
    plan = lexical.search(spark, path, "alpha")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[(]*segment", plan) and "bucket" in plan.split("PartitionFilters")[1] and "tok" in plan.split("PushedFilters")[1]


def test_index_keeps_itself(spark, tmp_path, fields):
    """Changed, removed and new chunks, merging, and a fresh start, each against a scan of what should be there."""
    path, there = f"{tmp_path}/i", {r[0]: r for r in ROWS}
    table = lambda: spark.createDataFrame(sorted(there.values(), key=lambda r: r[0]), DOCS)
    lexical.write(table(), fields, path, keep=["name"])
    steps = [([(2, "beta", "alpha"), (6, "alpha É", "beta beta")], [1]), ([(3, None, "alpha alpha")], [5, 77]), ([(7, "É", "missing")], []), ([], [2])]
    for new, gone in steps:
        ids = spark.createDataFrame([(i,) for i in gone], "gone long")
        version = lexical.change(spark, path, spark.createDataFrame(new, DOCS), fields, ids, keep=["name"])
        for i in gone:
            there.pop(i, None)
        there |= {r[0]: r for r in new}
        assert version.docs == len(there) and sorted(r["id"] for r in version.live().collect()) == sorted(there)
        same(spark, path, table(), fields, ("beta alpha",))
    many = len(version.segments)
    assert many > 2 and any(s["dead"] for s in version.segments)
    merged = lexical.merge(spark, path, most=2)
    assert len(merged.segments) < many and merged.docs == len(there)
    same(spark, path, table(), fields, ("alpha", "é"))
    assert lexical.merge(spark, path, every=True).segments[0]["dead"] == 0
    same(spark, path, table(), fields, ("alpha", "BETA, alpha!"))
    assert len(lexical.merge(spark, path, every=True).segments) == 1
    assert dict(lexical.current(spark, path).live().select("id", "name").collect()) == {i: r[1] for i, r in there.items()}
    assert lexical.remove(spark, path, spark.createDataFrame([(i,) for i in there], "x long")).docs == 0
    assert lexical.search(spark, path, "alpha").count() == 0
    lexical.change(spark, path, spark.createDataFrame(ROWS, DOCS), fields)
    there = {r[0]: r for r in ROWS}
    same(spark, path, table(), fields, ("alpha",))
    with pytest.raises(ValueError):
        lexical.change(spark, path, table(), {"text": (F.col("text"), "B")})
    lexical.write(table(), {"text": (F.col("text"), "B")}, path)
    assert lexical.current(spark, path).weights == ("B",)


def test_which_segments_merge():
    sizes = lambda *docs: tuple({"segment": i, "docs": n, "dead": 0} for i, n in enumerate(docs, 1))
    assert lexical.to_merge(sizes(1, 1, 1)) == [] and lexical.to_merge(sizes(900, 1, 2, 3, 1)) == [2, 3, 4, 5]
    assert lexical.to_merge(sizes(5, 6, 7, 15, 1)) == [1, 2, 3, 4]
    assert lexical.to_merge(({"segment": 3, "docs": 2, "dead": 3}, {"segment": 4, "docs": 9, "dead": 3})) == [3]


def test_only_cells_that_may_hold_the_best_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "CELL", 8)
    monkeypatch.setattr(lexical, "FIRST", 4)
    fields = {"name": (F.col("name"), "A"), "text": (F.col("text"), "C")}
    docs = spark.range(3000).select(
        "id", F.concat(F.lit("n"), F.col("id")).alias("name"), F.concat_ws(" ", F.repeat(F.lit("common "), (F.col("id") % 7 + 1).cast("int")), F.repeat(F.lit("x "), (F.col("id") % 90).cast("int"))).alias("text")
    )
    lexical.write(docs, fields, f"{tmp_path}/i")
    true = sorted(map(tuple, retrieval.text_search(docs, "common", fields).collect()), key=lambda r: (-r[1], r[0]))[:10]
    read = {}
    assert sorted(map(tuple, lexical.search(spark, f"{tmp_path}/i", "common", 10, read).collect())) == sorted(true)
    assert read["cells"] < read["of"] / 3
    scan = sorted(map(tuple, retrieval.bm25(docs, "common x", F.col("text")).collect()), key=lambda r: (-r[1], r[0]))[:10]
    read = {}
    found = lexical.bm25(spark, f"{tmp_path}/i", "common x", "C", k=10, read=read).collect()
    assert sorted(r["id"] for r in found) == sorted(r[0] for r in scan) and read["cells"] < read["of"]


def test_many_questions(spark, tmp_path, fields, monkeypatch):
    monkeypatch.setattr(lexical, "FIRST_MANY", 1)
    monkeypatch.setattr(lexical, "CELL", 2)
    rows = ROWS + [(10 + i, "alpha" if i % 2 else "gamma", "beta " * (i % 5) + "alpha " * (i % 3)) for i in range(40)]
    docs, path = spark.createDataFrame(rows, DOCS), f"{tmp_path}/i"
    lexical.write(docs.filter("id < 20"), fields, path)
    lexical.write(docs.filter("id >= 20"), fields, path, mode="append")
    lexical.remove(spark, path, spark.createDataFrame([(11,), (25,)], "id long"))
    docs = docs.filter("id not in (11, 25)")
    asked = [(1, "alpha"), (2, "Beta alpha"), (3, "missing"), (4, "alpha missing"), (5, None), (6, " ?"), (None, "gamma"), (7, "é"), (7, "gamma beta"), (8, "alpha"), (8, "Alpha, alpha")]
    got = {}
    for r in lexical.search_many(spark, path, spark.createDataFrame(asked, "qid long, text string"), 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for qid, text in asked[:7] + asked[9:]:
        best = sorted(map(tuple, retrieval.text_search(docs, text or "", fields).collect()), key=lambda r: (-r[1], r[0]))[:4]
        assert sorted(got.get(qid, [])) == [(n, i, s) for n, (i, s) in enumerate(best, 1)], (qid, text)
    assert sorted(n for n, *_ in got[7]) == sorted([1, 2, 1, 2, 3, 4])


def test_many_questions_in_blocks(spark, tmp_path, fields, monkeypatch):
    monkeypatch.setattr(lexical, "ROWS_GIVEN", 6)  # two sets of words in a block
    monkeypatch.setattr(lexical, "FIRST_MANY", 1)
    monkeypatch.setattr(lexical, "AT_FIRST", 1)
    monkeypatch.setattr(lexical, "CELL", 4)
    docs, path = spark.createDataFrame([(i, "alpha", "beta " * (i % 5) + "gamma " * (i % 3) + "delta") for i in range(60)], DOCS), f"{tmp_path}/b"
    lexical.write(docs, fields, path)
    asked = [(i, " ".join(w)) for i, w in enumerate([["alpha"], ["beta", "gamma"], ["delta"], ["gamma", "alpha", "delta"], ["beta"], ["beta", "none"]])]
    got = sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in lexical.search_many(spark, path, spark.createDataFrame(asked, "qid long, text string"), 3).collect())
    want = []
    for qid, text in asked:
        best = sorted(map(tuple, retrieval.text_search(docs, text, fields).collect()), key=lambda r: (-r[1], r[0]))[:3]
        want += [(qid, n, i, s) for n, (i, s) in enumerate(best, 1)]
    assert got == want


@pytest.mark.parametrize("sent", [200_000, 2])
def test_many_questions_without_an_index(spark, fields, monkeypatch, sent):
    """Only words that are asked are written, and lengths count all words; beyond so many words, all are written."""
    monkeypatch.setattr(lexical, "WORDS_SENT", sent)
    rows = ROWS + [(10 + i, "alpha" if i % 2 else None, "beta " * (i % 5) + "gamma " * (i % 3) + "other") for i in range(30)]
    docs, paths = spark.createDataFrame(rows, DOCS), []
    monkeypatch.setattr(lexical, "shared_folder", lambda s, name: paths.append(shared_folder(s, name)) or paths[-1])
    asked = [(1, "alpha"), (2, "Beta alpha"), (3, "missing"), (4, "é"), (5, None), (6, " ?")]
    got = sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in lexical.scan_many(docs, fields, spark.createDataFrame(asked, "qid long, text string"), 4).collect())
    want = []
    for qid, text in asked:
        best = sorted(map(tuple, retrieval.text_search(docs, text or "", fields).collect()), key=lambda r: (-r[1], r[0]))[:4]
        want += [(qid, n, i, s) for n, (i, s) in enumerate(best, 1)]
    assert got == want
    held = {r["tok"] for r in lexical.current(spark, paths[0])._table("postings").select("tok").collect()}
    assert held == ({"alpha", "beta", "é"} if sent > 2 else {"alpha", "beta", "é", "gamma", "other"})
    for none in (docs.filter("false"), docs):
        assert lexical.scan_many(none, fields, spark.createDataFrame([(1, None), (2, "zzz")], "qid long, text string")).count() == 0


def test_a_write_keeps_no_blocks_beside_the_postings(spark, tmp_path, fields):
    path = f"{tmp_path}/w"
    lexical.write(spark.createDataFrame(ROWS, DOCS), fields, path)
    assert spark.read.parquet(f"{path}/cut").count() == 0 and not (tmp_path / "w/written/segment=1/kind=1").exists()


def test_a_merge_sends_the_dead_to_the_postings(spark, tmp_path, fields, monkeypatch):
    path, plans, put = f"{tmp_path}/m", [], lexical._put

    def seen(before, number, blocks, weights):
        plans.append(blocks._jdf.queryExecution().executedPlan().toString())
        return put(before, number, blocks, weights)

    docs = spark.createDataFrame(ROWS, DOCS)
    lexical.write(docs, fields, path)
    lexical.remove(spark, path, docs.select("id").limit(1))
    monkeypatch.setattr(lexical, "_put", seen)
    with_no_hint = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lexical.merge(spark, path, every=True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_no_hint)
    assert "SortMergeJoin" not in plans[0] and "array_contains" not in plans[0]


def test_stored_index_of_an_empty_table(spark, tmp_path, fields):
    lexical.write(spark.createDataFrame([], DOCS), fields, f"{tmp_path}/e")
    for path in (f"{tmp_path}/e", f"{tmp_path}/none"):
        assert lexical.search(spark, path, "alpha").count() == lexical.search(spark, path, "alpha", 3).count() == 0
        assert lexical.bm25(spark, path, "alpha", "C").count() == 0
        assert lexical.search_many(spark, path, spark.createDataFrame([(1, "alpha")], "qid long, text string")).count() == 0
    assert lexical.merge(spark, f"{tmp_path}/e").docs == 0


def test_strategies(spark):
    chunks = spark.createDataFrame(
        [(1, "a/hooks/x.ts", 1, "function", "useIt"), (2, "a/x.test.ts", 5, "class", "other"), (3, "a/x.test.ts", 1, "class", None)],
        "id long, path string, start_line int, kind string, symbol string",
    )
    vec = spark.createDataFrame([(2, 0.9), (9, 0.8)], "id long, similarity double")
    txt = spark.createDataFrame([(9, 2.0)], "id long, score double")
    run = lambda s, **how: [(r["strategy"], r["id"]) for r in strategies.run(s, chunks, vec, txt, **how).orderBy("rank").collect()]
    assert run("metadata", subject="TESTS") == [("metadata", 3), ("metadata", 2)]
    assert run("metadata", subject="HOOKS") == [("metadata", 1)]
    assert run("metadata") == []
    assert run("symbol", question="useit") == [("symbol", 1)]
    assert run("symbol", question="zzz") == [("hybrid_v2", 9), ("hybrid_v2", 2)]
    assert run("hybrid", subject="TESTS") == [("hybrid", 9), ("hybrid", 3), ("hybrid", 2)]
    assert run("expanded", patterns=["%test%"]) == [("expanded", 3), ("expanded", 2), ("expanded", 9)]
    assert run("vector") == [("vector", 9), ("vector", 2)]
    with pytest.raises(ValueError):
        run("other")


def test_whole_contexts(spark):
    rows = [("b.py", 9, 0, "one\n"), ("a.py", 5, 1, "two\n"), ("b.py", 1, 2, "three\n"), ("c.py", 1, 3, "x" * 400)]
    chunks = spark.createDataFrame(rows, "path string, start int, ord int, body string")
    got = context.whole(chunks, [], 150, "path", "start", "ord", F.col("body"), language="en").first()
    head = "## Relevant Source Code\n\nFound 4 relevant code section(s) in the repository:\n"
    end = "---\n_Note: Showing 3/4 sections (token limit reached)_\n\nUse this information to answer accurately.\nAlways cite files using the format `[path:lines]`."
    assert got["context"] == f"{head}\n## 📄 b.py\n\nthree\none\n\n## 📄 a.py\n\ntwo\n\n{end}"
    assert (got["n_included"], got["n_total"], got["truncated"], got["files"]) == (3, 4, True, ["b.py", "a.py"])
    assert got["tokens"] == -(-len(got["context"]) // 4)
    flat = context.whole(chunks, [], 1000, "path", "start", "ord", F.col("body"), grouped=False, language="en").first()
    assert f"repository:\n\none\n\ntwo\n\nthree\n\n{'x' * 400}\n---\nUse" in flat["context"] and not flat["truncated"]
    none = context.whole(chunks.filter("false"), [], 100, "path", "start", "ord", F.col("body")).first()
    assert (none["context"], none["tokens"], none["n_total"], none["truncated"]) == ("Aucun code pertinent trouve dans le repository.", 10, 0, False)


def test_rerank_with_a_provider(spark):
    rows = spark.createDataFrame([(i, 1.0 / (i + 1), "red blue" if i % 2 else "red") for i in range(6)], "id long, score double, text string")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(retrieval.rerank_with(rows, "red blue", F.col("text"), k=3)) == [1, 3, 5]
    assert ids(retrieval.rerank_with(rows, "red blue", F.col("text"), least=0.6)) == [1, 3, 5]
    assert ids(retrieval.rerank_with(rows.limit(3), "red blue", F.col("text"))) == [0, 1, 2]
    assert ids(retrieval.rerank_with(rows, "red", F.col("text"), lambda q, d: [1.0], k=2)) == [0, 1]
    assert ids(retrieval.rerank_with(rows.filter("false"), "red", F.col("text"))) == []
