"""Mixing against the targets worked out by hand, on hot, repeated and empty sources."""

import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, queries


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Reshare what is over until none is above, in exact numbers."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, fixed = Fraction(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: Fraction(most * sizes[s]) for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(v) for s, v in (fixed | share).items()}
        fixed |= over


def check(rows, texts, tolerance):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in texts:
        sizes[source] += size(text)
    want = plain_targets(sizes)
    assert len(rows) == len(texts)
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance(s, want[s]), (s, taken[s], want[s])


def mixed(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    return mixing.mix(docs.withColumn("Taken", F.lit("x")), keep=True).withColumnRenamed("_taken", "taken")


@pytest.mark.parametrize("fold", [256, 4])
def test_sources(spark, monkeypatch, fold):
    monkeypatch.setattr(mixing, "FOLD", fold)  # a small fold makes buckets be refined often
    texts = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i % 40)) for i in range(3000)]
    texts += [(None, None, "a b c\tx"), (None, None, None), (1, "none", ""), (2, "none", None), (3, "tiny", "one"), (4, "tiny", "one two")]
    out = mixed(spark, texts)
    rows = out.collect()
    check(rows, texts, lambda s, t: 40 if s not in ("tiny", None) else 3)
    assert sorted(map(str, rows)) == sorted(map(str, mixed(spark, texts[::-1]).repartition(7).collect()))


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_which_rows_are_taken(spark, monkeypatch, most):
    """The choice, worked out by hand: rows below the threshold in hash order, then those of the last bucket that fit."""
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", most)
    texts = [(i, "hot" if i % 3 else None if i % 2 else f"s{i % 5}", "w " * (i * 7 % 40)) for i in range(1500)] + [(1, "s9", "long " * 200_000)]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string")
    hashed = df.select("*", F.shiftrightunsigned(F.xxhash64("doc_id", "source", "text"), 1).alias("h"), F.size(F.split(F.trim("text"), " ")).alias("n")).collect()
    got = {(r["doc_id"], r["source"]): r for r in mixed(spark, texts).collect()}
    for source in {t[1] for t in texts}:
        rows = sorted((r["h"], 0 if not r["text"] else r["n"], r["doc_id"]) for r in hashed if r["source"] == source)
        size, target = sum(n for _, n, _ in rows), got[rows[0][2], source]["target"]
        times = min(3, int(target // size)) if size else 0
        left, more = target - times * size, [got[i, source]["taken"] - times * n for _, n, i in rows]
        taken = [k for k, (_, n, _) in enumerate(rows) if n and more[k] == n]
        assert all(m in (0, n) for m, (_, n, _) in zip(more, rows, strict=True)) and sum(more) <= left + 1e-6
        # up to the first row that is passed over all are taken; after the last one that is taken none is
        passed = [k for k, (_, n, _) in enumerate(rows) if n and not more[k]]
        upto, k = 0, 0
        while passed and k < passed[0]:
            upto, k = upto + rows[k][1], k + 1
        assert not passed or upto + rows[passed[0]][1] > left
        assert not taken or not passed or taken[-1] - passed[0] <= mixing.FOLD


def test_many_sources(spark):
    texts = [(i, f"s{i}", "a b c") for i in range(3000)] + [(i, "hot", "x y") for i in range(1500)]
    check(mixed(spark, texts).collect(), texts, lambda s, t: 3)


def test_like_rows(spark):
    """A third of all rows are the same one: just some of them are taken."""
    texts = [(7, "a", "x y z")] * 500 + [(i, "b", "u v " * 3) for i in range(900)] + [(9, "c", "p q")] * 30
    rows = mixed(spark, texts).collect()
    check(rows, texts, lambda s, t: 6)
    assert len({r["taken"] for r in rows if r["source"] == "a"}) == 2


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(docs).count() == 0
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert tuple(mixing.mix(one).first()) == (1, 0, 0, 0.0, 0)


def test_targets():
    for sizes in ({"a": 10, "b": 0, "c": 5}, {"a": 1000, "b": 1, "c": 2, None: 3}, {"x": 1}, {}):
        if sizes:
            got, want = mixing.targets(sizes), plain_targets(sizes)
            assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in sizes)


def test_query(spark, medium):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    out = queries.op8_mixing(spark, medium)
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    rows = [r.asDict() | {"source": docs[r["doc_id"]]["source"]} for r in out.collect()]
    check(rows, [(d["doc_id"], d["source"], d["text"]) for d in docs.values()], lambda s, t: 0.03 * t)
    assert sorted(map(str, out.collect())) == sorted(map(str, queries.op8_mixing(spark, medium).collect()))
