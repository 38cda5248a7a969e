"""Benchmark decontamination: word n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased, signs around and in them dropped. Every run of `SEED` words of a test item is a seed, and none is
left out for being common. Where a document holds a seed, the stretch of words around it is aligned with the item (local
alignment, word against word); the score over that of the item with itself is the `score`. A stretch is not aligned if
it holds so few of the item's words that it can't reach the least score. So a copy is missed only if its edits leave no
`SEED` words of the item side by side. An item of fewer words is one seed: it matches where all of it stands.

Scale: the test items are taken in blocks of about `BLOCK` items or `BLOCK_CHARS` characters, which bounds what is sent to
tasks; per block there is one pass over the documents, without a shuffle. The join of seeds and the alignment happen where a document is read,
so a passage in a third of all documents costs no shuffle, and no two documents ever meet. A document with a seed that
many items have is compared with each of them; matches are taken `HITS` at a time, which bounds their memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import coded_words, hold_batches, mixed, slices, with_text

SEED = 3
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5
BLOCK, BLOCK_CHARS = 20_000, 20_000_000
HITS = 500_000


class Items:
    """A block of test items, coded by their own vocabulary."""

    def __init__(self, ids: list, texts: list):
        starts, vocabulary, codes = coded_words(pa.array(texts, pa.string()))
        bare = _bare(vocabulary)
        full = pc.greater(pc.binary_length(bare), 0)
        self.ids = np.array(ids, np.int64)
        self.words = pc.unique(bare.filter(full))
        self.starts, self.codes = _known(starts, vocabulary, codes, self.words)
        length = np.diff(self.starts)
        runs = [_runs(self.starts, self.codes, n) for n in range(1, SEED + 1)]
        # a seed of fewer words is one only for an item that has no more
        runs = [[x[(length[run[2]] == n) | (n == SEED)] for x in run] for n, run in enumerate(runs, 1)]
        self.lengths = [n for n, run in enumerate(runs, 1) if len(run[0])]
        h, at, item = (np.concatenate(x) for x in zip(*runs, strict=True))
        order = np.argsort(h, kind="stable")
        self.seeds, self.at, self.item = h[order], at[order], item[order]
        owner = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        self.has = np.unique(owner * len(self.words) + self.codes)


def _bare(vocabulary: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(vocabulary, r"[^\p{L}\p{N}]+", "")


def _known(starts: np.ndarray, vocabulary: pa.Array, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as places in `words`, -1 for others; what is only signs is no word."""
    bare = _bare(vocabulary)
    place = np.asarray(pc.fill_null(pc.index_in(bare, value_set=words), -1), np.int64)
    empty = np.asarray(pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False), bool)
    out = place[codes] if len(codes) else codes
    if empty.any():
        full = ~empty[codes]
        starts = np.concatenate(([0], np.cumsum(full)))[starts]
        out = out[full]
    return starts, out


def _runs(starts: np.ndarray, codes: np.ndarray, n: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word in its text, text) of every run of n known words. A text of fewer words has none."""
    if len(codes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    good = np.ones(len(codes) - n + 1, bool)
    for k in range(n):
        good &= codes[k : len(good) + k] >= 0
    first = np.flatnonzero(good)
    text = np.searchsorted(starts, first, "right") - 1
    inside = first + n <= starts[text + 1]
    first, text = first[inside], text[inside]
    h = np.full(len(first), SEED - n, np.uint64)
    for k in range(n):
        h = mixed(h * np.uint64(0x100000001B3) + codes[first + k].astype(np.uint64) + np.uint64(1))
    return h, first - starts[text], text


def align(queries: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of each query with its window (rows; -1 and below never match), and where each ends."""
    n, width = windows.shape
    before = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = -GAP * np.arange(width + 1, dtype=np.int32)
    for i in range(queries.shape[1]):
        word = queries[:, i : i + 1]
        step = np.where((windows == word) & (word >= 0), np.int32(MATCH), np.int32(MISMATCH))
        now = np.zeros_like(before)
        now[:, 1:] = np.maximum(np.maximum(before[:, :-1] + step, before[:, 1:] + GAP), 0)
        # gaps in the query's direction: the best of all cells to the left, less a gap for each step
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], now[better].argmax(axis=1)
        before = now
    return best, end


def _spans(counts: np.ndarray, most: int):
    """Slices of consecutive entries whose counts sum up to at most `most`; one that alone has more is a slice."""
    sums, low = np.cumsum(counts), 0
    while low < len(counts):
        high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + most, "right")))
        yield slice(low, high)
        low = high


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - first, counts)


def _candidates(items: Items, starts: np.ndarray, codes: np.ndarray, least: float) -> np.ndarray:
    """Rows (text, item, stretch): where a text has a seed of an item, and enough of its words for the least score."""
    h, at, text = (np.concatenate(x) for x in zip(*[_runs(starts, codes, n) for n in items.lengths], strict=True))
    low, high = np.searchsorted(items.seeds, h, "left"), np.searchsorted(items.seeds, h, "right")
    hits = np.flatnonzero(high > low)
    found = [np.empty((0, 3), np.int64)]
    for part in _spans((high - low)[hits], HITS):
        mine = hits[part]
        n = high[mine] - low[mine]
        hit, seed = np.repeat(mine, n), _places(low[mine], n)
        item = items.item[seed]
        stretch = (at[hit] - items.at[seed]) // np.diff(items.starts)[item]
        key = np.unique(np.stack((text[hit], item, stretch), 1), axis=0)
        first, last = _window(items, key, least)
        first = np.maximum(first, 0)
        last = np.minimum(last, np.diff(starts)[key[:, 0]])
        for some in _spans(last - first, HITS):
            width = (last - first)[some]
            word = codes[_places((starts[key[:, 0]] + first)[some], width)]
            look = np.repeat(key[some, 1], width) * len(items.words) + word
            there = (word >= 0) & (items.has[np.minimum(np.searchsorted(items.has, look), len(items.has) - 1)] == look)
            n_there = np.bincount(np.repeat(np.arange(len(width)), width)[there], minlength=len(width))
            found.append(key[some][n_there >= least * np.diff(items.starts)[key[some, 1]] - 1e-9])
    return np.unique(np.concatenate(found), axis=0)


def _window(items: Items, key: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """First word and the place after the last of the window of each (text, item, stretch).

    What scores `least` or more has at most 2 * (1 - least) words put in for each of the item's, on either side of the seed.
    """
    length = np.diff(items.starts)[key[:, 1]]
    more = np.ceil(MATCH * max(1 - least, 0) / -GAP * length).astype(np.int64)
    return key[:, 2] * length - more, (key[:, 2] + 2) * length + more


def _found(items: Items, texts: pa.Array, least: float):
    """(text, item, score, end) for each text and item with a seed in common: the best of its stretches that can score `least`."""
    starts, codes = _known(*coded_words(texts), items.words)
    key = _candidates(items, starts, codes, least)
    if not len(key):
        return None
    key = key[np.argsort(np.diff(items.starts)[key[:, 1]], kind="stable")]
    text, item, _ = key.T
    low, high = _window(items, key, least)
    length = np.diff(items.starts)[item]
    best, end = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    done = 0
    while done < len(text):
        cells = (high - low)[done : done + 512].max()
        take = max(1, min(512, 200_000 // cells))
        part = slice(done, done + take)
        longest = length[part].max()
        q = np.arange(longest)[None, :]
        inside = q < length[part, None]
        query = np.where(inside, items.codes[np.where(inside, items.starts[item[part], None] + q, 0)], -2)
        w = np.arange((high - low)[part].max())[None, :] + low[part, None]
        there = (w >= 0) & (w < np.diff(starts)[text[part], None])
        window = np.where(there, codes[np.where(there, starts[text[part], None] + w, 0)], -1)
        best[part], stop = align(query, window)
        end[part] = stop + w[:, 0]
        done += take
    score = best / (MATCH * length)
    order = np.lexsort((end, -score, item, text))
    text, item, score, end = text[order], item[order], score[order], end[order]
    first = np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])))
    return text[first], item[first], score[first], end[first]


def _blocks(items: DataFrame, block: int):
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-chars // BLOCK_CHARS))
    for b in range(parts):
        mine = items if parts == 1 else items.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == b)
        got = mine.toArrow()
        if got.num_rows:
            found = Items(got["id"].to_pylist(), got["text"].to_pylist())
            if len(found.seeds):
                yield found


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: float = SCORE,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document row and test item whose score is `least` or more: id, item_id, score, end_word.

    Null texts and items, and items without a word, match nothing; neither do items with a null id, which have no name
    to report (`clean` uses them). An item of fewer than SEED words matches where all of them stand side by side. Null
    document ids stay null; rows that repeat each give their rows. end_word is the place after the passage's last word.
    Empty tables give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    tests = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).filter("id is not null").distinct()
    schema = f"`{id_col}` long, `{item_col}` long, score double, end_word long"
    found = None
    hold_batches(docs)
    for items in _blocks(tests, block):

        def search(batches, items=items):
            for part in slices(batches):
                if (got := _found(items, part.column(1), least)) is None:
                    continue
                text, item, score, end = got
                good = score >= least
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text[good])), pa.array(items.ids[item[good]]), pa.array(score[good]), pa.array(end[good])],
                    [id_col, item_col, "score", "end_word"],
                )

        hits = rows.mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least: float = SCORE, block: int = BLOCK) -> DataFrame:
    """`docs` without the rows whose text holds a test item with score `least` or more; one pass per block.

    Items are taken by their text, whatever their id, null included. Null and empty texts, and documents when there is no
    item, stay; rows that repeat stay or go together; null ids are like any other.
    """
    tests = benchmark.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct().select(F.xxhash64("text").alias("id"), "text")
    kept = docs
    for items in _blocks(tests, block):
        rows, at, _ = with_text(kept, kept.columns, text_col)

        def drop(batches, items=items, at=at):
            for part in slices(batches):
                keep = np.ones(part.num_rows, bool)
                if (got := _found(items, part.column(at).cast(pa.string()), least)) is not None:
                    keep[got[0][got[2] >= least]] = False
                yield part.filter(pa.array(keep))

        kept = rows.mapInArrow(drop, docs.schema)
    return kept
