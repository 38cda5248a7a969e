"""Decontamination against a cell-by-cell alignment of every document with every item."""

import random
import re

import numpy as np

from quarry.llm import decontamination as D
from quarry.llm import queries


def words(text):
    return [w for w in (re.sub(r"[^\w]|_", "", x) for x in (text or "").lower().split()) if w]


def plain_score(item, text):
    """Smith-Waterman by the book."""
    best, rows = 0, [[0] * (len(text) + 1)]
    for a in item:
        row = [0]
        for j, b in enumerate(text):
            row.append(max(0, rows[-1][j] + (D.MATCH if a == b else D.MISMATCH), rows[-1][j + 1] + D.GAP, row[j] + D.GAP))
        best = max(best, *row)
        rows.append(row)
    return best / (D.MATCH * len(item))


def test_alignment():
    rng = np.random.default_rng(5)
    for _ in range(30):
        q, w = rng.integers(0, 6, (4, 9)), rng.integers(-1, 6, (4, 25))
        got, _ = D.align(q, w)
        assert [s / (D.MATCH * 9) for s in got] == [plain_score(a, b) for a, b in zip(q.tolist(), w.tolist(), strict=True)]


def made(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(12, 40)) for _ in range(12)]
    docs = [text(rng.randint(5, 300)) for _ in range(40)]
    for k, d in enumerate(docs[:24]):
        copy = list(items[k % 12])
        for _ in range(int(len(copy) * (0, 0.08, 0.15)[k % 3])):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["new"], ["two", "new"]])
        at = rng.randint(0, len(d))
        d[at:at] = copy
    return items, docs


def test_against_plain_search(spark):
    items, docs = made()
    rows = [(i, " ".join(d).capitalize() + ".", "x") for i, d in enumerate(docs)]
    rows += [(100, None, "x"), (101, "", "x"), (None, " ".join(items[0]), "x"), (0, rows[0][1], "x"), (102, " ".join(docs[20] * 300), "x")]
    tests = [(i, ", ".join(t)) for i, t in enumerate(items)] + [(90, None), (91, "two words"), (None, "a b c d"), (3, ", ".join(items[3]))]
    d = spark.createDataFrame(rows, "doc_id long, text string, Score string")
    b = spark.createDataFrame(tests, "item_id long, text string")
    for block in (1000, 4):
        got = D.leaks(d, b, block=block).collect()
        pairs = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
        for i, t, _ in rows:
            if i == 102:
                continue
            for k, item in enumerate(items):
                score = plain_score(item, words(t))
                assert (score >= D.SCORE) == ((i, k) in pairs), (i, k, score)
                if score >= D.SCORE:
                    assert abs(pairs[i, k] - score) < 1e-9
        assert (102, 8) in pairs and sum(r["doc_id"] == 0 for r in got) == 2
    b = b.filter("item_id is not null")
    bad = {r["doc_id"] for r in got}
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r[0] for r in rows if r[0] not in bad), key=str)


def trigrams(text):
    return {tuple(text[i : i + D.SEED]) for i in range(len(text) - D.SEED + 1)}


def test_edited_copies_of_common_items(spark):
    """Each item is leaked into 60 documents, much edited: a copy is found by whichever of its words were left alone."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(rng.randint(15, 20)) for _ in range(10)]
    docs = []
    for k in range(600):
        copy = list(items[k % 10])
        if k % 20 == 19:  # one long passage put in at the middle
            copy[len(copy) // 2 : len(copy) // 2] = text(len(copy) - 2)
        else:
            for at in rng.sample(range(len(copy)), len(copy) * (15, 20, 25, 30)[k % 4] // 100):
                copy[at] = f"new{rng.randrange(10**6)}"
        before = text(rng.randint(0, 40))
        docs.append(before + copy + text(rng.randint(0, 40)))
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    true = {(i, k % 10) for i, k in enumerate(range(600)) if plain_score(items[k % 10], docs[i]) >= D.SCORE and trigrams(items[k % 10]) & trigrams(docs[i])}
    assert len(true) > 550
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(d, b).collect()} == true
    assert {r["doc_id"] for r in D.clean(d, b).collect()} == set(range(600)) - {i for i, _ in true}


def test_hits_in_parts(spark, monkeypatch):
    """Taken a few at a time, seed hits give the same as all at once."""
    items, docs = made(4)
    coded = D.Items(list(range(12)), [" ".join(t) for t in items])
    texts = D.pa.array([" ".join(t) for t in docs])
    whole = D._found(coded, texts, D.SCORE)
    monkeypatch.setattr(D, "HITS", 7)
    assert len(whole[0]) and all((a == b).all() for a, b in zip(whole, D._found(coded, texts, D.SCORE), strict=True))


def test_short_items_and_items_without_an_id(spark):
    rows = [(1, "here are Two words, side by side"), (2, "two and words"), (3, "one"), (4, "a solo part"), (5, "x y z w v u"), (6, None), (7, ""), (None, "two words"), (4, "a solo part")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(1, "two words"), (2, "solo"), (None, "x y z w"), (3, "?!")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["score"]) for r in D.leaks(d, b).collect()), key=str)
    assert got == sorted([(1, 1, 1.0), (4, 2, 1.0), (4, 2, 1.0), (None, 1, 1.0)], key=str)
    assert sorted(r["doc_id"] for r in D.clean(d, b).collect()) == [2, 3, 6, 7]


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert D.leaks(d.filter("false"), b).count() == 0 and D.leaks(d, b.filter("false")).count() == 0
    assert D.clean(d, b.filter("false")).count() == 1 and D.clean(d, b).count() == 0


def test_query(spark, medium):
    """Whole items that stand in a document are all found, and nothing that no item is near."""
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontamination(spark, medium).collect()}
    inside = set()
    for r in spark.read.parquet(f"{medium}/documents.parquet").collect():
        text = " " + " ".join(words(r["text"])) + " "
        inside |= {(r["doc_id"], k) for k, item in items.items() if f" {' '.join(item)} " in text}
    assert inside and inside <= got and len(got) <= len(inside) * 1.1
