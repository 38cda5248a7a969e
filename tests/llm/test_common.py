"""Shared helpers: components, words, runs of words, names."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import _common as C
from quarry.llm._graph import components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab É\t\n ", max_size=30)), max_size=6), st.integers(1, 4))
def test_words_and_runs(texts, n):
    starts, hashes = C.word_hashes(pa.array(texts, pa.string()))
    words = [(t or "").lower().split() for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    known = dict(zip([w for t in words for w in t], hashes.tolist(), strict=True))
    assert len(set(known.values())) == len(known)
    at, runs = C.ngrams(starts, hashes, n)
    plain = [tuple(w[i : i + n]) for w in words for i in range(max(1, len(w) - n + 1)) if w]
    assert len(runs) == len(plain) == at[-1]
    assert len(set(zip(plain, runs.tolist(), strict=True))) == len(set(plain)) == len(set(runs.tolist()))


@pytest.mark.parametrize("tail", [" ", "  ", "\n", "\t \n", "\u00a0 "])
def test_a_text_has_the_same_words_at_every_place(spark, tail):
    """Equal texts that end in white space, alone, among others and in Spark's own batches."""
    text = f"one two É three{tail}"
    want = [C.hashes_of(pa.array([w]))[0] for w in text.lower().split()]
    for n in range(1, 40):
        starts, hashes = C.word_hashes(pa.array([text] * n))
        assert np.diff(starts).tolist() == [4] * n and hashes.tolist() == want * n
        starts, hashes = C.word_hashes(pa.array(["x" * n, text]))
        assert hashes[1:].tolist() == want

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(C.word_hashes(b.column(0))[0]))], ["n"])

    for parts in (1, 3, 7):
        rows = spark.range(500).select(F.lit(text).alias("text")).repartition(parts).mapInArrow(count, "n long")
        assert rows.filter("n <> 4").count() == 0 and rows.count() == 500


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Score int, _score int, x int")
    assert C.fresh(df, "score", "score", "y") == ["__score", "___score", "y"]
