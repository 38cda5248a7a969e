"""The file tree source, and table functions against the DataFrame operators."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators import chunking, context
from quarry.operators import retrieval as R
from quarry.sources import functions, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("tree")
    for name in ("a.txt", "x/b.txt", "x/y/c.txt", "x/y/d.txt", "z/e.txt", "w/v/u/f.txt"):
        os.makedirs((path / name).parent, exist_ok=True)
        (path / name).write_text(name)
    return str(path)


def read(spark, root, **options):
    spark.dataSource.register(tree.FileTree)
    out = spark.read.format("file_tree").option("root", root)
    for k, v in options.items():
        out = out.option(k, str(v))
    return {os.path.relpath(r["path"], root): r for r in out.load().collect()}


def test_whole_tree(spark, root):
    rows = read(spark, root, content="true", parts=2)
    assert set(rows) == {"a.txt", "x/b.txt", "x/y/c.txt", "x/y/d.txt", "z/e.txt", "w/v/u/f.txt"}
    assert all(bytes(r["content"]).decode() == name and r["size"] == len(name) and not r["truncated"] and r["error"] is None for name, r in rows.items())
    assert len({r["partition"] for r in rows.values()}) == 3
    assert all(r["content"] is None for r in read(spark, root).values())


def test_limit_and_budget(spark, root):
    rows = read(spark, root, most=2, parts=3)
    assert rows["x/b.txt"]["truncated"] and "x/y/d.txt" not in rows and not rows["z/e.txt"]["truncated"]
    rows = read(spark, root, calls=2, parts=3, content="true")
    assert rows["w/v/u"]["error"] == "no call left" and rows["w/v/u"]["truncated"]
    assert rows["x/b.txt"]["content"] is None and rows["x/b.txt"]["error"] == "no call left" and bytes(rows["z/e.txt"]["content"]) == b"z/e.txt"


def test_throttled_calls_are_tried_again():
    calls = []

    class Slow(tree.Folder):
        def fetch(self, path):
            calls.append(path)
            if len(calls) < 3:
                raise tree.Throttled
            return b"x"

    tree.SERVICES["slow"] = Slow
    reader = tree.Reader({"root": "", "service": "slow", "content": "true", "wait": "0"})
    assert [r[:4] for r in reader.read(tree.Part(0, (), (("p", 1),)))] == [("p", 1, b"x", None)] and len(calls) == 3
    del tree.SERVICES["slow"]


def test_table_functions(spark):
    rows = [(i, f"d/{'ab' * (i % 3)}c.py", "function" if i % 2 else "class", f"getUser{i}" if i % 4 else None, "alpha beta " * (i % 3) + "gamma", [float(i % 5), 1.0] if i % 6 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, path string, kind string, symbol string, content string, embedding array<double>")
    functions.register(spark, df)
    sql = lambda call: [tuple(r) for r in spark.sql(f"SELECT * FROM {call}").collect()]
    same = lambda a, b: sorted(a) == sorted(tuple(r) for r in b.collect())
    q = functions.vector([1, 2])
    vec = R.with_similarity(df, [1.0, 2.0]).select("id", "similarity")
    fields = {"s": (F.col("symbol"), "A"), "p": (F.regexp_replace("path", "^.*/", ""), "B"), "k": (F.col("kind"), "B"), "c": (F.col("content"), "C")}
    txt = R.text_search(df, "alpha beta", fields)
    assert same(sql(f"match_chunks({q}, 7, 0.5D)"), R.knn(df, [1.0, 2.0], 7, 0.5))
    assert same(sql(f"hybrid_chunks({q}, 'alpha beta', 6, 0.7D, 0.3D)"), R.hybrid_weighted(vec, txt, 6).select("id", "vector_score", "text_score", "combined_score"))
    assert same(sql(f"fused_chunks({q}, 'alpha beta', 60, 6, 50, 50)"), R.hybrid_rrf(vec, txt, 6).select("id", "vector_score", "text_score", "combined_score"))
    assert same(sql("like_symbols('getuser', 'class', 4)"), R.fuzzy_symbols(df, "getuser", "symbol", ("kind", "class"), 4).select("id", "symbol", "similarity"))
    assert same(sql("like_files('abc py', 3)"), R.fuzzy_files(df, "abc py", "path", 3).select("path", "chunk_count", "similarity"))
    assert sql(f"fused_chunks({q}, ' ? ', 60, 6, 50, 0)") == sql(f"fused_chunks({q}, 'nowhere', 60, 6, 50, 0)")


def test_python_table_functions(spark):
    code = "def one(x):\n    return [x + 1 for _ in range(100) if x > 10]\n"
    files = spark.createDataFrame([("a.py", code), ("b.txt", "text " * 30), (None, "x"), ("c.py", None)], "path string, content string")
    functions.register(spark, spark.createDataFrame([], "id long, path string, kind string, symbol string, content string, embedding array<double>"))
    files.createOrReplaceTempView("given_files")
    got = spark.sql("SELECT path, f.* FROM given_files, LATERAL cut_file(path, content) f")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, chunking.chunk_files(files).collect()), key=repr)
    texts = spark.createDataFrame([(1, "see [a/b.ts:3-9], [x/y.py:4] and [c/d.go] [m/d.x](l)"), (2, None), (3, "none")], "id long, t string")
    texts.createOrReplaceTempView("given_texts")
    cited = spark.sql("SELECT id, c.place, c.path, c.start_line, c.end_line FROM given_texts, LATERAL citations(t) c")
    want = context.citations(texts, "t").select("id", "n", "path", "line", "end_line")
    assert sorted(map(tuple, cited.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_listing_tells_what_it_leaves_out(spark, root):
    from quarry.sources import store

    rows = store.listed(spark, root, 3).orderBy("path").collect()
    assert len(rows) == 3 and all(r["truncated"] for r in rows) and rows[0]["path"].endswith("a.txt")
    assert {r["truncated"] for r in store.listed(spark, root, 6).collect()} == {False}
