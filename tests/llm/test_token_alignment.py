"""Alignment against comparing all pairs of tokens, with both tokenizers called directly."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import queries
from quarry.llm import token_alignment as T

BYTE_LEVEL = Tokenizer.from_file(T.BYTE_LEVEL)
BYTE_LEVEL.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=T.PIECES)
ODD = [
    "Hello world. Ça va?日本語 😀 ok\n\n  two\t tabs", "", None, " ", "a", "don't 123,456 — “quoted”", "<|endoftext|> </s> <s> <unk> <0x41>",
    "a▁b", "a\u0000b", "x" * 300, "   lead and trail   ", "é ﬁ Ⅷ ½   ​", "日本語" * 40, "\r\n\r\n\t" * 30, "Привет мир", "🏳️‍🌈" * 9,
]


def tokens(text):
    """(ids, ends) by A and by B; none if a side's bytes differ from space+text."""
    whole = f" {text}".encode() if text else b""
    signs = T.byte_signs()
    a = BYTE_LEVEL.encode(f" {text}", add_special_tokens=False) if text else None
    a_bytes = [bytes(signs[c] for c in t) for t in a.tokens] if text else []
    b = PIECES.encode(text) if text else []
    piece = lambda i: bytes([int(PIECES.id_to_piece(i)[3:5], 16)]) if PIECES.is_byte(i) else PIECES.id_to_piece(i).replace("▁", " ").encode()
    b_bytes = [piece(i) for i in b]
    if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return ([], []), ([], [])
    return (a.ids, np.cumsum([len(x) for x in a_bytes]).tolist()), (b, np.cumsum([len(x) for x in b_bytes]).tolist())


def plain(rows):
    """The summary, by definition."""
    told, links = [], []
    for i, text in rows:
        (a, a_ends), (b, b_ends) = tokens(text)
        common = sorted(set(a_ends) & set(b_ends))
        parts, low = [], 0
        for end in common:
            mine = [[str(x) for x, e in zip(*side, strict=True) if low < e <= end] for side in ((a, a_ends), (b, b_ends))]
            parts.append("|".join(",".join(x) for x in mine))
            low = end
        linked, j0 = [], 0
        for x, e, s in zip(a, a_ends, [0, *a_ends], strict=False):
            while j0 < len(b) and b_ends[j0] <= s:
                j0 += 1
            j = j0
            while j < len(b) and (b_ends[j - 1] if j else 0) < e:
                linked.append((x, b[j]))
                j += 1
        links.append(linked)
        told.append([i, len(a), len(b), len(common), len(linked), hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""])
    count = Counter(x for linked in links for x in linked)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(*t[:5], sum(count[x] == most[x[1]] for x in linked), sum(count[x] for x in linked), t[5]) for t, linked in zip(told, links, strict=True)]


def texts():
    rng = random.Random(3)
    words = ["the", "alignment", "naïve", "über", "x9", "\n", "  ", "foo_bar", "日本", "don't", "😀", "3.14"]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 80))) for _ in range(40)]


def rows_of():
    rows = [(i, t) for i, t in enumerate(ODD + texts())]
    return [*rows, (0, ODD[0]), (0, ODD[0]), (None, "no id here"), (None, None), (500, "long words and " * 3000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, N_A int, pairs string").repartition(3)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_vocabularies():
    c = T.coder(T.BYTE_LEVEL, T.PIECES)
    assert len(c.a) == 50_257 and len(c.b) == 32_000 and c.a[50_256] == b"" and not any(" " in x[1:].decode(errors="ignore").lstrip() for x in c.b)
    for t in filter(None, ODD):
        assert c.a_ids(t).tolist() == BYTE_LEVEL.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("length", [20_000, 1_000_000])
def test_long_white_space(length):
    c = T.coder(T.BYTE_LEVEL, T.PIECES)
    text = "a" + " " * length + "b"
    ((a, b),) = c.encoded([text])
    assert c.a_bytes[a].sum() == c.b_bytes[b].sum() == len(text) + 1


@pytest.mark.parametrize("how", [{}, {"block": 3}, {"sent": 0}, {"block": 7, "sent": 0}])
def test_against_all_pairs_of_tokens(spark, how):
    rows = rows_of()
    out = T.summary(table(spark, rows), **how)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(out.collect()) == ordered(plain(rows))


def test_tasks_that_hold_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(T, "HELD", 40)
    rows = rows_of()
    assert ordered(T.summary(table(spark, rows), sent=0).collect()) == ordered(plain(rows))


def test_groups(spark):
    rows = [(i, t) for i, t in enumerate(ODD + texts())]
    out = T.groups(table(spark, rows), block=5)
    assert out.columns == ["doc_id", "start", "end", "a_ids", "b_ids"]
    by = {}
    for r in sorted(out.collect(), key=lambda r: (r["doc_id"], r["start"])):
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in rows:
        (a, a_ends), (b, b_ends) = tokens(text)
        mine = by.get(i, [])
        assert [x for r in mine for x in r["a_ids"]] == list(a) and [x for r in mine for x in r["b_ids"]] == list(b)
        assert [r["end"] for r in mine] == sorted(set(a_ends) & set(b_ends)) and [r["start"] for r in mine] == [0, *[r["end"] for r in mine]][: len(mine)]


def test_empty(spark):
    none = table(spark, [(1, "x")]).filter("false")
    assert T.summary(none).count() == T.groups(none).count() == T.summary(none, sent=0).count() == 0
    assert ordered(T.summary(table(spark, [(1, None), (2, "")])).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_machine_keeps_only_what_is_open():
    c = T.coder(T.BYTE_LEVEL, T.PIECES)
    ((a, b),) = c.encoded(["plain words in a row " * 2000])
    machine, most, seen = T.Machine(c), 0, 0
    ends = [np.cumsum(n[x]) - n[x] for n, x in ((c.a_bytes, a), (c.b_bytes, b))]
    blocks = sorted((int(e[s]), side, x[s : s + 50]) for side, (x, e) in enumerate(zip((a, b), ends, strict=True)) for s in range(0, len(x), 50))
    for at, side, ids in blocks:
        some = machine.put(side, at, ids)
        seen += 0 if some is None else len(some[1])
        most = max(most, sum(len(x) for q in machine.queues for x in q))
    assert most < 250 and seen + len(machine.groups()[1]) == len(a)


def test_query(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert ordered(queries.op13_token_alignment(spark, small).collect()) == ordered(plain(rows))
