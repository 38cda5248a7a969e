"""The index of names, vectors of many queries, and strategies of many questions, each against its form for one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical, names, retrieval, strategies
from quarry.plans import answers, search

NAMES = ["getUser", "get_user", "getUsers", "setUser", "user getter", "x", "", "élan vital", "getUser", None, "a b c d e f", "userget", "get user list all"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    rows = spark.createDataFrame([(i, n, "f" if i % 2 else "c") for i, n in enumerate(NAMES)], "id long, symbol string, kind string")
    names.write(rows, "symbol", path, ["id", "kind"])
    return rows, path


@pytest.mark.parametrize("query", ["getUser", "get user", "élan", "zzz", "", "x"])
def test_names_like_one(spark, stored, query):
    rows, path = stored
    want = [(r["id"], r["symbol"], r["similarity"]) for r in retrieval.fuzzy_symbols(rows, query, "symbol").collect()]
    assert [(r["id"], r["name"], r["similarity"]) for r in names.rows_like(spark, path, query).collect()] == want
    only = [r["id"] for r in retrieval.fuzzy_symbols(rows, query, "symbol", ("kind", "f"), 3).collect()]
    assert [r["id"] for r in names.rows_like(spark, path, query, 3, F.col("kind") == "f").collect()] == only
    files = [tuple(r) for r in retrieval.fuzzy_files(rows.filter("symbol is not null"), query, "symbol").select("symbol", "chunk_count", "similarity").collect()]
    assert [tuple(r) for r in names.names_like(spark, path, query).collect()] == files


def test_names_like_many(spark, stored):
    rows, path = stored
    asked = [(1, "getUser"), (2, "get user"), (3, "zzz"), (4, None), (5, "user"), (6, "")]
    got = {}
    for r in names.rows_like_many(spark, path, spark.createDataFrame(asked, "qid long, text string"), 4).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["similarity"]))
    for qid, text in asked:
        want = [(n, r["id"], r["similarity"]) for n, r in enumerate(retrieval.fuzzy_symbols(rows, text or "", "symbol", k=4).collect(), 1)]
        assert sorted(got.get(qid, [])) == want, text


def test_only_the_first_rows_of_a_name_meet_the_questions(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"blue ring{'s' if i % 3 == 0 else ''}") for i in range(90)], "id long, symbol string")
    names.write(rows, "symbol", str(tmp_path), ["id"])
    found = names.rows_like_many(spark, str(tmp_path), spark.createDataFrame([(1, "blue ring"), (2, "ring")], "qid long, text string"), 4)
    assert "row_number() windowspecdefinition(name" in found._jdf.queryExecution().optimizedPlan().toString()
    want = [(q, n, r["id"], r["name"]) for q, text in ((1, "blue ring"), (2, "ring")) for n, r in enumerate(names.rows_like(spark, str(tmp_path), text, 4).collect(), 1)]
    assert sorted((r["qid"], r["rank"], r["id"], r["name"]) for r in found.collect()) == want


def test_answers_need_no_index_of_all_words(spark, small, monkeypatch):
    """A session without an index writes none for the questions' few words, and finds what one with an index does."""
    rows = lambda: sorted(map(tuple, answers.answers_many(spark, small).collect()))
    search._index(spark, small)
    stored = rows()
    monkeypatch.setattr(search, "_WRITTEN", {})
    monkeypatch.setattr(lexical, "write", None)
    assert rows() == stored and len(stored) > 0


def test_lists_outside_the_lengths_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, "common " * (1 + i // 10) + " ".join(f"w{j}" for j in range(i))) for i in range(60)], "id long, symbol string")
    names.write(rows, "symbol", str(tmp_path), ["id"])
    found = names.similar(spark, str(tmp_path), "common w0")
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(size" in plan and "bucket" in plan.split("PartitionFilters")[1] and 0 < found.count() < 60


def plain(chunks, queries, k):
    out = []
    for qid, q in queries:
        if q is None or not np.linalg.norm(q) > 0:
            continue
        like = [(-round(float(np.dot(q, v) / np.linalg.norm(q) / np.linalg.norm(v)), 9), i) for i, v in chunks if v is not None and len(v) == len(q) and np.linalg.norm(v) > 0]
        out += [(qid, i, -s, n) for n, (s, i) in enumerate(sorted(like)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [1024, 3])
def test_many_vectors(spark, block):
    rng = np.random.default_rng(2)
    chunks = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(90)] + [(200, None), (201, [0.0] * 4), (202, [1.0, 2.0]), (203, [])]
    queries = [(i, v) for i, v in chunks[:7]] + [(50, None), (51, [0.0] * 4), (52, [2.0, 1.0]), (53, [1.0])]
    c, q = spark.createDataFrame(chunks, "id long, embedding array<double>"), spark.createDataFrame(queries, "qid long, query array<double>")
    found = retrieval.knn_per_query(c, q, 5, query_block=block, chunk_block=20 * block)
    assert found.columns == ["qid", "id", "similarity", "rank"]
    assert sorted((r["qid"], r["id"], round(r["similarity"], 9), r["rank"]) for r in found.collect()) == plain(chunks, queries, 5)
    assert retrieval.knn_per_query(c, q.filter("false"), 5).count() == retrieval.knn_per_query(c.filter("false"), q, 5).count() == 0


def test_weights_by_form(spark):
    forms = spark.createDataFrame([("identifier",), ("code",), ("natural_language",), (None,)], "form string")
    got = [tuple(r["w"]) for r in forms.select(strategies.weights_of(F.col("form")).alias("w")).collect()]
    assert got == [(0.4, 0.6), (0.8, 0.2), (0.7, 0.3), (0.7, 0.3)]


def test_many_as_one(spark):
    chunks = spark.createDataFrame(
        [(1, "a/hooks/x.ts", 1, "function", "useIt"), (2, "a/x.test.ts", 5, "class", "other"), (3, "a/x.test.ts", 1, "class", None), (4, "b/types/y.d.ts", 2, "type", "useItem")],
        "id long, path string, start_line int, kind string, symbol string",
    )
    vec = spark.createDataFrame([(2, 0.9), (9, 0.8), (3, 0.8)], "id long, similarity double")
    txt = spark.createDataFrame([(9, 2.0), (4, 0.1)], "id long, score double")
    asked = [(1, "metadata", "TESTS", ""), (2, "symbol", "GENERIC", "useit"), (3, "symbol", "GENERIC", "zzz"), (4, "hybrid", "TESTS", ""), (5, "vector", "GENERIC", ""), (6, "hybrid_v2", "X", ""), (7, "metadata", "GENERIC", "")]
    questions = spark.createDataFrame(asked, "qid long, strategy string, subject string, text string").withColumn("weights", strategies.weights_of(F.lit("x")))
    ids = questions.select("qid")
    symbols = retrieval.fuzzy_symbols(chunks, "useit", "symbol").select(F.lit(2).cast("long").alias("qid"), "id", "similarity")
    got = {}
    for r in strategies.run_many(questions, chunks, ids.crossJoin(vec), ids.crossJoin(txt), symbols).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["strategy"], r["id"], round(r["score"], 9)))
    for qid, strategy, subject, text in asked:
        want = [(r["rank"], r["strategy"], r["id"], round(r["score"], 9)) for r in strategies.run(strategy, chunks, vec, txt, text, subject).orderBy("rank").collect()]
        assert sorted(got.get(qid, [])) == want, strategy
