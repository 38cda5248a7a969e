"""Small operators: nested redaction, filter reports, deletion with its count, existence, size warnings."""

import json

from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import corpus
from quarry.sources import store


def test_redact_json(spark):
    deep = {"a": {"b": {"Api_Key": {"x": 1}, "note": "Bearer abc", "n": None, "list": ["token: abc"]}}, "token": [1], "t": True}
    rows = [(1, json.dumps(deep)), (2, None), (3, "no json"), (4, '"password: x"'), (5, "[1]"), (6, "{}")]
    got = {r["id"]: r["x"] for r in spark.createDataFrame(rows, "id long, t string").select("id", T.redact_json(F.col("t")).alias("x")).collect()}
    want = {"a": {"b": {"Api_Key": "[REDACTED]", "note": "[REDACTED]", "n": None, "list": ["token: abc"]}}, "token": "[REDACTED]", "t": True}
    assert got[2] is None and got[3] is None and got[4] == '"[REDACTED]"' and got[5] == "[1]" and got[6] == "{}"


def test_redact_looks_once_at_clean_texts(spark):
    rows = spark.createDataFrame([("plain",), ("a password: x b",), (None,)], "t string")
    assert [r[0] for r in rows.select(T.redact(F.col("t"))).collect()] == ["plain", "a [REDACTED] b", None]


def test_filter_report(spark):
    files = [("big", "src/a.py", 4000), ("big", "src/b.py", 3000), ("big", "package.json", 400), ("big", "other/c.py", 100), ("big", "x.png", 9), ("none", "x.bin", 5), ("small", "o/a.py", 50)]
    df = spark.createDataFrame(files, "repo string, path string, size long")
    got = {r["repo"]: r for r in corpus.filter_report(df, "repo", most_lines=120).collect()}
    big = got["big"]
    assert (big["files"], big["kept"], big["kept_bytes"], big["excluded"], big["filtered"], big["is_prioritised"], big["is_empty"]) == (5, 2, 4400, 3, 1, True, False)
    assert big["warnings"] == ["Repository is large (~0k lines). Only priority folders will be indexed: src, lib, app, pages, components, etc.", "Indexed 2 of 4 files due to size limit."]
    assert got["none"]["is_empty"] and got["none"]["warnings"] == [corpus.NO_CODE] and got["small"]["warnings"] == [] and got["small"]["kept"] == 1
    reasons = {(r["repo"], r["path"]): r["reason"] for r in corpus.excluded(df, "repo", most_lines=120).collect()}
    assert reasons == {("big", "src/b.py"): "size", ("big", "other/c.py"): "size", ("big", "x.png"): "binary", ("none", "x.bin"): "binary"}


def test_deleted_and_exists(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    left, n = store.deleted(df, F.col("x") > 1)
    assert n == 1 and left.count() == 2
    assert store.exists(df, F.col("x") == 2) and not store.exists(df, F.col("x") == 3)


def test_size_warning(spark):
    rows = spark.createDataFrame([(50_000,), (50_001,), (None,)], "kb long").select(P.size_warning(F.col("kb")).alias("w")).collect()
    assert [tuple(r["w"]) for r in rows] == [(False, 50_000, 50_000), (True, 50_001, 50_000), (None, None, 50_000)]
