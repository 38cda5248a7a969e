"""Language ID against vectors put together letter by letter, and on held-out documents."""

import zlib

import numpy as np

from quarry.llm import langid, queries


def plain_vector(text):
    """Sum over trigrams of rolled letter vectors multiplied, one trigram at a time."""
    v, out = langid._letter, np.zeros(langid.DIMENSIONS)
    s, last = [0], 0
    for c in text.lower():
        now = ord(c) if c.isalpha() else 0
        if now or last:
            s.append(now)
        last = now
    s += [0] if s[-1] else []
    for a, b, c in zip(s, s[1:], s[2:], strict=False):
        out += np.roll(v(a), 2).astype(float) * np.roll(v(b), 1) * v(c)
    return out


def test_bundles():
    for text in ("abc", "a", "Éa ß! x", "one two  three", "  lead", "ab 12 cd", "Ελλάδα и Кириллица 中文字", "𐐀𐐁 𝔞"):
        assert np.allclose(langid.bundle(langid.trigrams(text)), plain_vector(text)), text
    assert not len(langid.trigrams("12 !?")) and not len(langid.trigrams(None))
    far = [langid._letter(p).astype(int) for p in (0, ord("a"), ord("а"), 0x4E2D, 0x4E2D + 37)]
    assert all(abs(a @ b) < 200 for i, a in enumerate(far) for b in far[:i])  # no two letters share a vector


def test_held_out_accuracy(spark, medium):
    rows = queries.op5_langid(spark, medium)
    truth = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "lang")
    got = rows.join(truth, "doc_id").collect()
    assert len(got) == truth.count()
    held = [r for r in got if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 100)
    rng = np.random.default_rng(6)
    word = lambda: "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 20_000, 5))
    taught = [(f"l{i}", word()) for i in range(5000)]
    model = langid.learn(spark.createDataFrame(taught, "lang string, text string").repartition(3))
    assert len(model.languages) == 5000 and model.languages == sorted(model.languages)
    docs = spark.createDataFrame(taught[::100], "lang string, text string")
    assert all(r["lang"] == r["lang_pred"] and r["score"] > 0.99 for r in langid.predict(docs, model).collect())


def test_odd_rows(spark):
    taught = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "xx"), (4, "whatever", None), (5, "12", "no")]
    model = langid.learn(spark.createDataFrame(taught, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = [(1, "the dog and cat", "a"), (2, None, "b"), (3, "", "c"), (4, "123 !", "d"), (None, "und der hund " * 50_000, None), (1, "the dog and cat", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Lang_Pred string")
    out = langid.predict(docs, model)
    assert out.columns == ["doc_id", "text", "Lang_Pred", "_lang_pred", "score"]
    got = {r["Lang_Pred"]: (r["_lang_pred"], r["score"]) for r in out.collect()}
    assert out.count() == 6 and got["a"][0] == "en" and got[None][0] == "de"
    assert got["b"] == got["c"] == got["d"] == ("und", 0.0) and all(0 <= s <= 1 for _, s in got.values())
    empty = langid.learn(docs.withColumnRenamed("Lang_Pred", "lang").filter("false"))
    assert {r["_lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
