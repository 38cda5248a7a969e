"""Building and refreshing an index, with providers that fail."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import indexing as I

FILES = [
    ("src/a.py", "def one(x):\n    return [x + 1 for _ in range(100) if x > 10]\n"), ("src/b.py", "class Two:\n    name = 'a text that is long enough to be kept'\n"),
    ("node_modules/c.py", "def three(x):\n    return [x + 1 for _ in range(100) if x > 10]\n"), ("d.png", "x" * 100),
]


def test_build_and_refresh(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    index = I.build(files)
    rows = {r["path"]: r for r in index.collect()}
    assert set(rows) == {"src/a.py", "src/b.py"} and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-4 for r in rows.values())
    changed = spark.createDataFrame([(FILES[0][0], FILES[0][1].replace("100", "200")), ("src/e.py", FILES[0][1])], "path string, content string")
    seen = spark.sparkContext.accumulator(0)

    def counting(texts):
        seen.add(len(texts))
        return I.hashed_words(texts)

    after = {r["path"]: r for r in I.refreshed(index, changed, embed=counting).collect()}
    assert set(after) == {"src/a.py", "src/e.py"} and after["src/a.py"]["id"] != rows["src/a.py"]["id"] and seen.value == 2
    same = I.refreshed(index, files)
    assert sorted(r["id"] for r in same.collect()) == sorted(r["id"] for r in rows.values())


def test_blank_texts_have_zero_vectors(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in I.embedded(rows, "text").collect()}
    assert not any(got[2]) and not any(got[3]) and any(got[1]) and len(got[2]) == I.DIMENSIONS
    assert I.embedded(rows.filter("false"), "text").count() == 0


def test_vectors_are_made_and_given_batch_by_batch(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace

    class Rows(SimpleNamespace):
        def withColumn(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return list(run([pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"t{i}" if i % 3 else " " for i in range(1000)])], ["id", "text"])]))

    monkeypatch.setattr(I.F, "col", lambda name: name)
    monkeypatch.setattr(I, "StructType", lambda fields: fields)
    seen = []
    got = I.embedded(Rows(columns=["id"], schema=SimpleNamespace(fields=[])), "text", lambda texts: seen.append(len(texts)) or I.hashed_words(texts))
    assert max(b.num_rows for b in got) <= I.EMBED_BATCH and max(seen) <= I.EMBED_BATCH
    rows = pa.Table.from_batches(got).to_pydict()
    assert rows["id"] == list(range(1000)) and [any(v) for v in rows["embedding"]] == [i % 3 > 0 for i in range(1000)]


def test_tries():
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise I.Throttled if len(calls) == 1 else ValueError
        return texts

    assert I.tried(flaky, ["a"], second=0) == ["a"] and len(calls) == 3

    def never(texts):
        raise I.Refused

    with pytest.raises(I.Refused):
        I.tried(never, ["a"], second=0)


def test_descriptions(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, text string")
    few = I.described(rows, "text", lambda texts: [t.upper() for t in texts[:-1]])
    assert few.filter("context is null").count() >= 1 and few.filter(F.col("context") == F.upper("text")).count() >= 30
    assert I.described(rows, "text").filter("context is not null").count() == 0


def test_results_are_remembered_for_a_time(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, " ")], "id long, text string")
    calls, path = spark.sparkContext.accumulator(0), f"{tmp_path}/cache"

    def counting(texts):
        calls.add(len(texts))
        return I.hashed_words(texts)

    def run(now, more=None):
        given = rows if more is None else rows.unionByName(spark.createDataFrame(more, rows.schema))
        before = calls.value
        out = {r["id"]: r["embedding"] for r in I.remembered(given, "text", path, now, counting).collect()}
        return out, calls.value - before

    first, n = run("2024-01-01 00:00:00")
    assert n == 2 and set(first) == {1, 2, 3, 4, 5} and first[1] == first[2] and any(first[1]) and not any(first[4]) and not any(first[5])
    assert run("2024-01-01 00:04:59") == (first, 0)
    assert run("2024-01-01 00:04:00", [(6, "new")])[1] == 1
    assert run("2024-01-01 00:05:01")[1] == 2


def test_units_end_at_their_own_brace():
    from quarry.operators import chunking as C

    body = "export function one() {\n  const a = '}'; // }\n  /* } */ return `}${a}` + \"}\"\n  if (a) { b() }\n}\n"
    rest = "export class Two {\n  name = 'text that is long enough to be kept'\n"
    found = list(C.units(body + rest, "typescript"))
    assert [(a, b, kind, name) for a, b, kind, name, _ in found] == [(1, 5, "function", "one"), (6, 8, "class", "Two")]
    rust = "pub fn first<'a>(x: &'a str, c: char) -> bool {\n    c == '{' || c == '\\'' || x == \"}\"\n}\npub struct Second { a: u8, some_longer_name_of_a_field: u8 }\n"
    assert [(a, b, name) for a, b, _, name, _ in C.units(rust, "rust")] == [(1, 3, "first"), (4, 4, "Second")]
    broken = "def one(x):\n    return (x +\n\n    1 and a line that is long enough\ndef two(y:\n    pass  # a second one that is long enough to be kept\n"
    assert [(a, b, name) for a, b, _, name, _ in C.units(broken, "python")] == [(1, 4, "one"), (5, 7, "two")]


def test_imports_of_python_by_its_tree():
    from quarry.operators import chunking as C

    code = "import os, sys\nfrom a.b import c\nfrom . import d\nfrom ..e import f\ndef g():\n    import os.path as p\ns = 'import no'\nimport sys\n"
    assert C.depends_on(code, "python") == ["os", "sys", "a.b", ".", "..e", "os.path"]
    assert C.python_imports("import (") is None and C.depends_on("import x\nimport (", "python") == ["x", "("]


def test_stored_index_follows_the_files(spark, tmp_path):
    from quarry.operators import lexical
    from quarry.operators import retrieval as R

    path, calls = f"{tmp_path}/index", spark.sparkContext.accumulator(0)
    code = lambda name, body: f"import {body}\ndef {name}(x):\n    return [x + 1 for {body} in range(100) if x > 10]\n"
    there = {f"src/{n}.py": code(n, n * 2) for n in ("one", "two", "three", "four")}
    files = lambda: spark.createDataFrame(sorted(there.items()), "path string, content string")

    def counting(texts):
        calls.add(len(texts))
        return I.hashed_words(texts)

    def same():
        fresh = I.build(files())
        for query in ("range", "one", "oneone", "py function", "five"):
            want = sorted(map(tuple, R.text_search(fresh, query, I.fields()).collect()))
            assert sorted(map(tuple, lexical.search(spark, path, query).collect())) == want, query
        live = lexical.current(spark, path).live()
        assert sorted(r["path"] for r in live.collect()) == sorted(there)
        vector = I.hashed_words(["range"])[0]
        assert sorted(map(tuple, R.knn(live, vector, 3).collect())) == sorted(map(tuple, R.knn(fresh, vector, 3).collect()))

    assert I.refreshed_store(files(), path, embed=counting).docs == 4 and calls.value == 4
    there.pop("src/two.py")
    there["src/three.py"] = code("three", "other")
    there["src/five.py"] = code("five", "five")
    assert I.refreshed_store(files(), path, embed=counting).docs == 4 and calls.value == 6
    same()
    assert I.refreshed_store(files(), path, embed=counting).docs == 4 and calls.value == 6
