"""The join against all pairs, with components that are split and texts that repeat."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import ngram_jaccard as J
from quarry.llm import queries


def plain(rows, least=0.8):
    """[(class_id, links)] per row, by all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    links, inverted = defaultdict(set), defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            inverted[g].append(i)
    for i, s in enumerate(sets):
        near = defaultdict(int)
        for g in s:
            for k in inverted[g]:
                near[k] += 1
        links[i] = {k for k, n in near.items() if k != i and n / (len(s) + len(sets[k]) - n) >= least}
    seen, out = {}, [None] * len(rows)
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = [], [i]
        seen[i] = True
        while todo:
            at = todo.pop()
            group.append(at)
            for k in links[at]:
                if k not in seen:
                    seen[k] = True
                    todo.append(k)
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[k] = (min(ids) if ids else None, len(links[k]))
    return out


def made():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    rows, template = [], [word() for _ in range(120)]
    for i in range(90):  # near copies of one text
        t = list(template)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " ".join(word() for _ in range(rng.randrange(1, 80)))) for i in range(60)]
    rows += [(400 + i, rows[95][1].upper()) for i in range(30)] + [(None, rows[96][1]), (None, rows[3][1]), (None, None), (None, None)]
    rows += [(500, None), (501, ""), (502, " \n "), (503, "one"), (504, "ONE"), (505, "one two three four five"), (506, "one two three four")]
    rows += [(507, "loop it up and down " * 9000), (508, "loop it up and down " * 7000), (5, rows[5][1]), (5, rows[5][1]), (7, rows[100][1])]
    return rows


@pytest.mark.parametrize("block, most", [(400_000, 40), (700, 1000), (700, 2)])
def test_against_all_pairs(spark, monkeypatch, block, most):
    """Groups in one block, in many, and groups that go back to their nodes."""
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "MOST_BLOCKS", most)
    rows = made()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Class string").repartition(5)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in J.join(docs).collect()), key=str)
    want = sorted(((r[0], *w) for r, w in zip(rows, plain(rows), strict=True)), key=str)
    assert got == want


@pytest.mark.parametrize("most", [200_000, 0])
def test_unique(spark, monkeypatch, most):
    monkeypatch.setattr(J, "BROADCAST_ROWS", most)
    rows = [r for r in made() if r[0] != 7]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, Keep string")
    out = J.unique(docs)
    assert out.columns == docs.columns
    want = defaultdict(list)
    for r, (c, _) in zip(rows, plain(rows), strict=True):
        if (r[1] or "").split():
            want[c].append(r[0])
    blank = [r[0] for r in rows if not (r[1] or "").split()]
    got = sorted((r["doc_id"] for r in out.collect()), key=str)
    assert got == sorted([min(i for i in ids if i is not None) if any(i is not None for i in ids) else None for ids in want.values()] + blank, key=str)


def test_depth():
    for s in (0.8, 0.9):
        d = J.depth_for(s)
        assert J.found_at(s, d) >= J.RECALL and (d == J.DEPTH or J.found_at(s, d + 1) < J.RECALL)


def test_runs():
    """Nodes of sorted paths: those that branch, and those at the edge of a task's part."""
    shared = np.array([0, 8, 5, 8, 8, 2, 8])  # 8 rows
    at = lambda level: [tuple(int(v) for v in x) for x in zip(*J._runs(shared, level, level == 8), strict=True)]
    assert at(8) == [(0, 1, 1), (1, 3, 0), (3, 6, 0), (6, 8, 1)]
    assert at(6) == [(0, 1, 1), (6, 8, 1)]
    assert at(5) == [(0, 1, 1), (1, 6, 0), (6, 8, 1)]
    assert at(2) == [(0, 1, 1), (1, 8, 1)]


def test_values_shared():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n)) for n in (1, 5, 80, 200, 250, 40)]
    starts, flat = np.concatenate(([0], np.cumsum([len(x) for x in sets]))), np.concatenate(sets)
    a, b = np.triu_indices(6, 1)
    assert J._shared(starts, flat, a, b).tolist() == [len(np.intersect1d(sets[i], sets[k])) for i, k in zip(a, b, strict=True)]


@pytest.mark.parametrize("strip", [1_000_000, 5])
def test_pairs(strip):
    group, block = np.array([1, 1, 1, 2, 5, 5, 5, 5]), np.array([0, 1, 0, 0, 0, 1, 1, 0])
    every = {(i, k) for i in range(8) for k in range(i + 1, 8) if group[i] == group[k]}
    got = [p for a, b in J._pairs(group, block, False, strip) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(every) and set(got) == every
    got = [p for a, b in J._pairs(group, block, True, strip) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(got) == {(i, k) for i, k in every if block[i] != block[k]}


def test_each_pair_meets_once():
    """Whatever the paths, a pair that shares a node is verified at one level, in one node."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2, (12, J.TREES, J.DEPTH)).astype(np.uint16)
    values[:, :, :5] = values[:1, :, :5] + (rng.random((12, J.TREES, 1)) < 0.7)
    times = np.zeros((12, 12), int)
    for level in range(J.DEPTH, 4, -1):
        keys = lambda d: np.stack([J._node_keys(values[:, t], t, d) for t in range(J.TREES)])  # noqa: E731, B023
        here, deeper = keys(level), keys(level + 1) if level < J.DEPTH else None
        for t in range(J.TREES):
            for key in np.unique(here[t]):
                inside = np.flatnonzero(here[t] == key)
                a, b = (inside[x] for x in np.triu_indices(len(inside), 1))
                on = J._meet(a, b, np.full(12, t), np.full(12, -1), here, deeper)
                times[a[on], b[on]] += 1
    shares = (values[:, None, :, :5] == values[None, :, :, :5]).all(-1).any(-1)
    assert (times == np.triu(shares, 1)).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.join(docs).count() == 0 and J.unique(docs).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, J.join(blank).collect())) == [(1, 1, 0), (2, 2, 0)]


def test_query(spark, medium):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in queries.op9_ngram_jaccard(spark, medium).collect()}
    assert got == {r[0]: w for r, w in zip(rows, plain(rows), strict=True)}


def test_weak_links_beside_strong_ones(spark):
    """Texts that have strong links still find their weak ones."""
    rng, rows = random.Random(4), []
    for g in range(300):
        base = [f"v{rng.randrange(5000)}" for _ in range(104)]
        weak = list(base)
        weak[40] = weak[60] = "other"  # ten of a hundred shingles: 90 / 110 of the base
        near = list(base)
        near[-1] = "other"
        rows += [(3 * g, " ".join(base)), (3 * g + 1, " ".join(near)), (3 * g + 2, " ".join(weak))]
    want = {r[0]: w for r, w in zip(rows, plain(rows), strict=True)}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(n for _, n in want.values()) >= 1500 and got == want
