"""Token counts against another library's offsets, and the rules against one token at a time."""

import re
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import queries
from quarry.llm import token_counts as T

TEXTS = ["Hello world. Ça va?日本語 😀 ok\n\n  two\t tabs", "", None, "a" * 5000, "one. two. three.\nfour" * 2000, "don't 123,456 — “quoted”"]


def test_spans():
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    for text in filter(None, TEXTS):
        starts, ends = T.token_spans(text)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == other.encode(text, add_special_tokens=False).offsets


@pytest.mark.parametrize("text", ["a" + " " * 9 + "b", " " * 9, "a" + "\n" * 9 + "b\u2003" + " " * 7 + "\n", "x\t\t\t\t\t\t", "\u00a0" * 8 + "é" + " " * 6 + "!"])
def test_long_white_space_is_cut_where_the_pattern_cuts(monkeypatch, text):
    want = T.token_spans(text)
    monkeypatch.setattr(T, "LONG_BLANK", re.compile(r"[^\S\x1c-\x1f]{5,}"))
    assert all((a == b).all() for a, b in zip(want, T.token_spans(text), strict=True))


@pytest.mark.parametrize("text", ["." * 1_000_000, "?!" * 500_000 + " end", "a" * 1_000_000, " " * 1_000_000, "\n" * 300_000])
def test_long_runs_take_no_square_of_their_length(text):
    began = time.monotonic()
    ends, spans = T.section_ends(text), T.token_spans(text)
    assert ends[-1] == spans[1][-1] == len(text)
    assert time.monotonic() - began < 60


def test_sections():
    parts = lambda t: [t[a:b] for a, b in zip([0, *T.section_ends(t)[:-1]], T.section_ends(t), strict=True)]
    assert parts("One. Two?! three.four\n\n five... ") == ["One. ", "Two?! ", "three.four\n\n ", "five... "]
    assert not len(T.section_ends(""))


@pytest.mark.parametrize("rule", ["first", "most"])
def test_rules(rule):
    rng = np.random.default_rng(3)
    for _ in range(200):
        cuts = np.unique(rng.integers(0, 40, 12))
        starts, ends = cuts[:-1], cuts[1:]
        marks = np.unique(rng.integers(0, 40, 8))
        keep = rng.random(max(0, len(marks) - 1)) < 0.8
        s_start, s_end = marks[:-1][keep], marks[1:][keep]
        want, outside, crossing = np.zeros(len(s_start), int), 0, 0
        for a, b in zip(starts, ends, strict=True):
            shared = [max(0, min(b, e) - max(a, s)) for s, e in zip(s_start, s_end, strict=True)]
            on = [i for i, n in enumerate(shared) if n > 0]
            crossing += len(on) > 1
            at = [i for i in on if s_start[i] <= a] if rule == "first" else sorted(on, key=lambda i: (-shared[i], i))
            if at:
                want[at[0]] += 1
            else:
                outside += 1
        got = T.attribute(starts, ends, s_start, s_end, rule)
        assert (got[0].tolist(), got[1], got[2]) == (want.tolist(), outside, crossing)


def test_rows(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)] + [(None, "x", 9), (0, TEXTS[0], 9)], "doc_id long, text string, N_tokens int")
    out = T.count_tokens(docs)
    assert out.columns == ["doc_id", "text", "N_tokens", "_n_tokens", "section_tokens", "outside", "crossing"] and out.count() == len(TEXTS) + 2
    for r in out.collect():
        text = r["text"] or ""
        assert r["_n_tokens"] == len(T.token_spans(text)[0]) == sum(r["section_tokens"]) and r["outside"] == 0
        assert len(r["section_tokens"]) == len(T.section_ends(text))
    given = spark.createDataFrame([(1, "ab cd ef", [(0, 2), (3, 5)]), (2, "ab", None), (3, None, [(0, 1)])], "doc_id long, text string, parts array<struct<start: int, end: int>>")
    got = {r["doc_id"]: (r["section_tokens"], r["outside"]) for r in T.count_tokens(given, sections_col="parts").collect()}
    assert got == {1: ([1, 1], len(T.token_spans("ab cd ef")[0]) - 2), 2: ([], 1), 3: ([0], 0)}
    assert T.count_tokens(docs.filter("false")).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(docs, rule="other")


def test_query(spark, small):
    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op6_token_counts(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["n_tokens"] == len(other.encode(texts[r["doc_id"]], add_special_tokens=False).ids) == sum(r["section_tokens"])
