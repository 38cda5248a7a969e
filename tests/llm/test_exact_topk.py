"""Top-k against numpy over all pairs."""

import numpy as np
import pytest

from quarry.llm import exact_topk as X
from quarry.llm import queries


def plain(rows, k=20, step=20):
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % step == 0}):
        v = next(v for i, v in good if i == q)
        scores = sorted(((int((v[: min(len(v), len(w))] * w[: min(len(v), len(w))]).sum()), i) for i, w in good if i != q), key=lambda x: (-x[0], x[1]))
        out += [(q, n, i, s) for n, (s, i) in enumerate(scores[:k], 1)]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string").repartition(3)
    return sorted(tuple(r) for r in X.top_k(df, lambda i: i % 20 == 0, **more).collect())


@pytest.mark.parametrize("block", [4096, 2])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(X, "STEP", 50 if block == 2 else 4096)
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(230, 12)).astype(np.float32)
    vectors[rng.random(vectors.shape) < 0.5] = 0  # sparse rows, and ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.round(vectors, 1))]
    rows += [(-40, rows[3][1]), (300, None), (301, [None] * 12), (320, [float("nan")] * 12), (302, [float("inf")] + [0.0] * 11), (303, [1.0]), (340, []), (None, rows[1][1])]
    rows += [(400 + i, rows[7][1]) for i in range(60)]
    assert found(spark, rows, query_block=block, candidate_block=70 if block == 2 else 4096) == plain(rows)
    assert found(spark, rows[:6]) == plain(rows[:6])


def test_large_values_and_empty(spark):
    rows = [(0, [3e7, -2e7]), (1, [3e7, 1e7]), (2, [-1e7, 5.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0])]) == []


def test_many_candidates_of_large_components(spark):
    rng = np.random.default_rng(9)
    for size in (3e7, 5e7):  # quantised to about 1.9e9 and 3.2e9, whose products fit in a long
        rows = [(i, [float(np.float32(x)) for x in rng.normal(size=2) * size / 4]) for i in range(60)]
        assert found(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e10, 1e10]), (1, [1e10, 1e10])])


def test_best():
    scores = np.array([[3, 5, 5, 1, 5], [2, 2, 2, 2, 2]])
    assert X._best(scores, 2).tolist() == [[1, 2], [0, 1]]
    assert sorted(X._best(scores, 4)[0].tolist()) == [0, 1, 2, 4]


def test_query(spark, medium):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{medium}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op10_exact_topk(spark, medium).collect()) == plain(rows)
