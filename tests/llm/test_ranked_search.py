"""Ranked search against scoring every document, and its WAND against plain sums."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries
from quarry.llm import ranked_search as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def plain(docs, items, k=50):
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def told(rows):
    return sorted(rows, key=repr)


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, Score int, rank string").repartition(3)
    q = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    return told(tuple(r) for r in R.rank(d, q, **more).collect())


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünïté", "日本語", "naïve", "ÉTÉ", "X9"]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(70)] + [docs[3], docs[3]]
    docs += [(None, docs[7][1]), (None, None), (2000, None), (2001, ""), (2002, " ._- "), (2003, "w1," * 30_000), (2004, "W1-w2_w3\tÜnïté|été")]
    items = [(i, text(int(rng.integers(1, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "w3 w3 w5"), (53, "w1 w2"), (53, "w4"), (53, "w4"), (54, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"k": 5}, {"block": 200, "shard": 300}])
def test_against_all_documents(spark, corpus, how):
    docs, items = corpus
    assert found(spark, docs, items, **how) == told(plain(docs, items, how.get("k", 50)))


def test_heaps_merge_in_parts(spark, corpus, monkeypatch):
    monkeypatch.setattr(R, "MERGED", 1)
    docs, items = corpus
    assert found(spark, docs, items, k=7) == told(plain(docs, items, 7))


def test_empty(spark, corpus):
    docs, items = corpus
    assert found(spark, [], items) == found(spark, docs, []) == found(spark, [], []) == []
    assert found(spark, [(1, None), (2, "..")], items) == []


def test_columns(spark):
    docs = spark.createDataFrame([("a", "one two", 1)], "RANK string, body string, score int")
    items = spark.createDataFrame([(1, "two")], "rank int, q string")
    out = R.rank(docs, items, id_col="RANK", text_col="body", item_col="rank", item_text="q")
    assert out.columns == ["rank", "_rank", "__RANK", "score"] and out.count() == 1


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_terms(piece):
    for text in ["", " ", "abc", "A-b_C  d9É.ß", "x" * 50 + " y", "日本語 日本" * 5, " lead and trail "]:
        assert [w.decode() for some in R.terms(text.encode(), piece) for w in some] == words(text)


def test_wand_skips_and_loses_nothing():
    rng = np.random.default_rng(6)
    n = 20_000
    for k in (1, 10, 50):
        lists, parts = [], []
        for share, most in ((0.7, 40), (0.5, 60), (0.05, 900), (0.01, 2000), (0.0, 1), (0.001, 2500)):
            at = np.flatnonzero(rng.random(n) < share)
            lists.append(at)
            parts.append(rng.integers(1, most + 1, len(at)))
        total = np.zeros(n, np.int64)
        for at, part in zip(lists, parts, strict=True):
            total[at] += part
        best = np.lexsort((np.arange(n), -total))[:k]
        visited = []
        scores, at = R.wand(lists, parts, n, k, visited=visited)
        assert at.tolist() == best.tolist() and scores.tolist() == total[best].tolist()
        assert sum(visited) < n / 4
    few = R.wand([np.array([3, 5])], [np.array([2, 2])], 9, 4)
    assert few[1].tolist() == [3, 5]
    assert R.wand([np.arange(9)], [np.zeros(9, np.int64)], 9, 4)[0].tolist() == []


def test_query(spark, medium):
    docs, items = (spark.read.parquet(f"{medium}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = plain([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    out = queries.op11_ranked_search(spark, medium)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert told(tuple(r) for r in out.collect()) == told(want)
