"""Quality classifier: held-out accuracy, and what odd tables give."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import quality, queries


def test_held_out_accuracy(spark, medium):
    rows = queries.op2_quality(spark, medium)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    assert rows.count() == spark.read.parquet(f"{medium}/documents.parquet").count()
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.97


def test_indicators_are_those_of_a_plain_count():
    texts = ["The The the a", "x", "", None, "A b c"]
    owner, bucket = quality.indicators(pa.array(texts, pa.string()))
    assert set(owner.tolist()) == {0, 1, 4}
    assert len(set(zip(owner.tolist(), bucket.tolist(), strict=True))) == len(owner)
    again = quality.indicators(pa.array([texts[4]], pa.string()))[1]
    assert again.tolist() == bucket[owner == 4].tolist()  # a text's indicators don't depend on its neighbours


def test_descent_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 3]) > 0, 1.0, -1.0)
    w = quality.descend([np.arange(5)] * 80, list(x), y, np.full(80, 100.0), 5, rounds=200)
    assert (np.sign(x @ w[:5] + w[5]) == y).mean() > 0.95


def test_odd_rows(spark):
    good = [(i, f"plain words of number {i} with some more words", 1) for i in range(40)]
    bad = [(100 + i, "spam spam spam spam!! $$$ spam" + " spam" * i, 0) for i in range(40)]
    rows = spark.createDataFrame([*good, *bad, *good[:3], (None, None, None), (7, "x", None)], "id long, text string, label int")
    model = quality.train(rows)
    odd = [(1, "spam spam spam spam spam!! $$$", "a"), (2, "plain words of number with some", "b"), (3, None, None), (None, "", "c"), (5, "spam " * 200_000, "d"), (2, "plain words of number with some", "b")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, Score string")
    out = quality.score(docs, model)
    assert out.columns == ["doc_id", "text", "Score", "_score"]
    got = {(r["doc_id"], r["Score"]): r["_score"] for r in out.collect()}
    assert out.count() == len(odd) and all(0 <= v <= 1 for v in got.values())
    assert got[1, "a"] < 0.5 < got[2, "b"] and got[5, "d"] < 0.5 and got[3, None] == got[None, "c"]


def plain_indicators(text):
    words = (text or "").split()
    shape = lambda w: re.sub(r"\d+", "0", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", w)))
    shapes = ["again" if i and w == words[i - 1] else shape(w) for i, w in enumerate(words)]
    out = set()
    for kind, (values, n) in enumerate((([w.lower() for w in words], 1), ([w.lower() for w in words], 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        out |= {(kind, *values[i : i + n]) for i in range(max(1, len(values) - n + 1)) if values}
    return out


def test_against_plain_counts(spark):
    """Ratios and scores put together indicator by indicator; the fit by its optimum."""
    rng = random.Random(5)
    words = ["Alpha", "beta", "gamma", "delta", "x1", "y22", "EPS"]
    text = lambda c: " ".join(rng.choice(words[:5] if c else words[2:]) for _ in range(rng.randint(3, 9)))
    rows = [(i, text(i % 2), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = quality.train(df.repartition(3))
    of = [plain_indicators(t) for _, t, _ in rows]
    n = [sum(c == k for _, _, c in rows) for k in (0, 1)]
    ratio = {}
    for g in set().union(*of):
        have = [sum(g in s for s, (_, _, c) in zip(of, rows, strict=True) if c == k) for k in (0, 1)]
        ratio[g] = np.log((have[1] + 1) / (n[1] + 2) / ((have[0] + 1) / (n[0] + 2))) if sum(have) >= quality.LEAST_TEXTS else 0.0
    assert np.allclose(sorted(x for x in ratio.values() if x), np.sort(model.ratio[model.ratio != 0]), atol=1e-6)
    bucket = {}
    for (_, t, _), mine in zip(rows, of, strict=True):  # an indicator's bucket is what all its texts have in common
        at = set(quality.indicators(pa.array([t]))[1].tolist())
        for g in mine:
            bucket[g] = bucket.get(g, at) & at
    for g, at in bucket.items():
        assert any(abs(model.ratio[b] - ratio[g]) < 1e-6 for b in at)
    got = {r["id"]: r["score"] for r in quality.score(df, model).collect()}
    for i, t, c in rows:
        at = quality.indicators(pa.array([t]))[1]
        v = model.ratio[at].astype(float)
        margin = v @ model.weight[at] / max(np.sqrt(v @ v), 1e-9) + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-4 * margin))) < 1e-5
        assert np.isclose(v @ v, sum(ratio[g] ** 2 for g in of[i]), rtol=1e-4)
    again = quality.train(df.orderBy(F.desc("id")).repartition(7))
    assert (again.weight == model.weight).all() and again.bias == model.bias  # tasks and order don't matter


def test_descent_reaches_the_optimum():
    """The gap between the hinge loss and its dual is closed."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 4))
    y, cost = np.where(x[:, 0] + rng.normal(size=60) > 0, 1.0, -1.0), np.full(60, 0.7)
    w = quality.descend([np.arange(4)] * 60, list(x), y, cost, 4, rounds=2000)
    primal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w[:4] + w[4]))).sum()
    assert all(primal(w) <= primal(w + d) + 1e-2 for d in rng.normal(size=(300, 5)) * 0.1)


def test_bound_of_the_fit(spark):
    """The fit's sample is bounded, ids that repeat or are null included, also behind the bound of labelled rows."""
    rows = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("id"), F.concat(F.lit("w"), "id").alias("text"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    model = quality.train(rows, fit_per_class=100)
    assert np.isfinite(model.bias)


def test_without_labels(spark):
    none = spark.createDataFrame([], "id long, text string, label int")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert quality.score(docs, quality.train(none)).first()["score"] == 0.5
    one = spark.createDataFrame([(1, "a b c", 1)] * 3, "id long, text string, label int")
    assert quality.score(docs, quality.train(one)).first()["score"] > 0.5
    assert quality.score(docs.filter("false"), quality.train(none)).count() == 0


def test_disputed_labels_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert [(r["id"], r["label"]) for r in queries.labelled(docs, labels, "quality").collect()] == [(2, 1)]
    assert queries.labelled(docs, labels.filter(F.lit(False)), "quality").count() == 0
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("quality"))
    assert 200 < queries.labelled(many, many, "quality", most=400).count() < 600
