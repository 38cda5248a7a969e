"""Ranked lexical search of a stated set of items over all documents, by WAND in every shard of documents.

Two passes. The first reads every text once, as bytes, and keeps how many terms it has and how often those of the items
stand in it; that narrow table is written. Sums over it give the documents, the words and the documents per term, from
which the weights of the terms follow. In the second pass a shard is the documents of one task (cut where its postings
would pass `SHARD`): its posting lists are put in the order of the documents' ids, each with the highest impact that it
has there. An item's documents are visited in windows of that order. Terms whose highest impacts together don't pass the
heap's threshold can bring no document in by themselves; the lists of the others name the pivots, and a pivot is scored
only if the highest impacts of all lists that it may stand in pass the threshold. All others are skipped, in lists that
are long by binary search. The shards' heaps merge through rankings, first in parts, then by item.

Scale: the texts are never shuffled. A task holds one shard's postings and the items of one block, whose bytes are
bounded by `BLOCK`; more items are more blocks, each a pass of its own. At most k rows leave a shard for an item. What
comes to the driver is a block of items and a count per term of it.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ._common import cut, hold_batches, slices

#: Bytes of the texts of one block of items.
BLOCK = 8 << 20
#: Postings that a shard has at most (but for one document's).
SHARD = 8_000_000
#: Documents of an item's first window; each is twice as wide as the one before, up to the second number.
WINDOW = (512, 16_384)
#: Heaps that one task merges in the first ranking.
MERGED = 64
#: Letters, digits and every byte of other characters stay; A-Z become small; all else separates.
TERM_BYTES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def terms(text: bytes, piece: int = 1 << 20):
    """Lists of the terms of a text, about `piece` bytes of it at a time."""
    at = 0
    while at < len(text):
        end = at + piece
        part = text[at:end].translate(TERM_BYTES)
        while end < len(text) and b" " not in part:  # a term longer than the piece
            more = text[end : end + piece].translate(TERM_BYTES)
            part, end = part + more, end + piece
        if end < len(text):
            whole = part.rfind(b" ") + 1
            part, end = part[:whole], at + whole
        yield part.split()
        at = end


def counted(texts: pa.Array, code: dict[bytes, int]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """For each text: its number of terms, the codes of those that `code` has, how often each stands in it."""
    sizes, held, often = [], [], []
    for text in pc.cast(pc.cast(texts, pa.large_string()), pa.large_binary()).to_pylist():
        n, found = 0, []
        for some in terms(text or b""):
            n += len(some)
            found.append(np.fromiter((c for c in map(code.get, some) if c is not None), np.int32))
        codes, counts = np.unique(np.concatenate(found) if found else np.empty(0, np.int32), return_counts=True)
        sizes.append(n)
        held.append(codes)
        often.append(counts.astype(np.int32))
    return sizes, held, often


def weight(n: int, df: int) -> int:
    """Weight of a term that df of n documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _merge(scores, at, more, more_at, k: int):
    """The k best of two lists of (score, place), by score and then place."""
    scores, at = np.concatenate((scores, more)), np.concatenate((at, more_at))
    best = np.lexsort((at, -scores))[:k]
    return scores[best], at[best]


def wand(lists: list[np.ndarray], parts: list[np.ndarray], n: int, k: int, window: tuple[int, int] = WINDOW, visited: list | None = None):
    """(scores, places) of the k best of n documents, best first, equal scores by place; only scores above 0.

    `lists`: the sorted places of the documents that hold each term; `parts`: what the term adds to each. `visited`
    gets the number of documents scored."""
    peaks = np.array([p.max() if len(p) else 0 for p in parts], np.int64)
    order = np.argsort(peaks, kind="stable")
    lists, parts, peaks = [lists[t] for t in order], [parts[t] for t in order], peaks[order]
    below = np.cumsum(peaks)
    scores, at, least = np.empty(0, np.int64), np.empty(0, np.int64), 0
    low, width = 0, window[0]
    while low < n:
        high = min(n, low + width)
        few = int(np.searchsorted(below, least, "right"))  # these terms alone can't pass the threshold
        if few == len(lists):
            break
        spans = [np.searchsorted(x, (low, high)) for x in lists]
        bound = np.zeros(high - low, np.int64)
        for t in range(few, len(lists)):
            a, b = spans[t]
            bound[lists[t][a:b] - low] += peaks[t]
        pivots = np.flatnonzero((bound > 0) & (bound + (below[few - 1] if few else 0) > least))
        if len(pivots):
            exact, places = np.zeros(len(pivots), np.int64), pivots + low
            for t in range(len(lists)):
                a, b = spans[t]
                here, part = lists[t][a:b], parts[t][a:b]
                if not len(here):
                    continue
                if len(here) < 4 * len(pivots):
                    wide = np.zeros(high - low, np.int64)
                    wide[here - low] = part
                    exact += wide[pivots]
                else:
                    j = np.minimum(np.searchsorted(here, places), len(here) - 1)
                    exact += np.where(here[j] == places, part[j], 0)
            if visited is not None:
                visited.append(len(pivots))
            good = exact > least
            if good.any():
                scores, at = _merge(scores, at, exact[good], places[good], k)
                least = int(scores[-1]) if len(scores) == k else 0
        low, width = high, min(2 * width, window[1])
    return scores, at


def _searched(ids: pa.Array, sizes: np.ndarray, starts: np.ndarray, codes: np.ndarray, often: np.ndarray, items, weights: np.ndarray, docs: int, words: int, k: int):
    """(item, id, score) of the k best documents of one shard for every item."""
    order = np.asarray(pc.sort_indices(ids, null_placement="at_end"))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner = np.repeat(np.arange(len(sizes)), np.diff(starts))
    norm = 50 + 50 * sizes * docs // words
    tf = often.astype(np.int64)
    parts = weights[codes] * (1_000_000_000 * tf // (1000 * tf + 20 * norm[owner]))
    by = np.lexsort((place[owner], codes))
    places, parts = place[owner][by], parts[by]
    ends = np.searchsorted(codes[by], np.arange(len(weights) + 1))
    out = []
    for i, own in enumerate(items):
        spans = [(ends[c], ends[c + 1]) for c in own if ends[c] < ends[c + 1]]
        if spans:
            scores, at = wand([places[a:b] for a, b in spans], [parts[a:b] for a, b in spans], len(sizes), k)
            out.append((np.full(len(at), i, np.int32), order[at], scores))
    if not out:
        return None
    item, at, scores = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(at)), pa.array(scores)], ["item", "id", "score"])


def _block(docs: DataFrame, texts: list[str | None], k: int, shard: int) -> DataFrame:
    """(item, id, score): at least the k best documents for each of the texts, item being its place among them."""
    own = [sorted({t for some in terms((text or "").encode()) for t in some}) for text in texts]
    vocabulary = sorted({t for ts in own for t in ts})
    code = {t: i for i, t in enumerate(vocabulary)}
    items = [[code[t] for t in ts] for ts in own]
    id_type = docs.schema["id"].dataType
    held = StructType(
        [StructField("id", id_type), StructField("n", LongType()), StructField("terms", ArrayType(IntegerType())), StructField("often", ArrayType(IntegerType()))]
    )

    def count(batches):
        for part in slices(batches):
            sizes, codes, often = counted(part.column(1), code)
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (codes, often)]
            full = pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "often"])
            yield full.filter(pc.greater(full.column(1), 0))

    hold_batches(docs)
    postings = cut(docs.mapInArrow(count, held))
    sums = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n, words = sums["docs"], sums["words"] or 0
    weights = np.zeros(len(vocabulary), np.int64)
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # a row per term of the block
        weights[r["t"]] = weight(n, r["df"])

    def search(batches):
        kept, room = [], shard

        def found():
            table = pa.Table.from_batches(kept).combine_chunks()
            lists, often = (table[c].chunk(0) for c in ("terms", "often"))
            starts = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64))))
            return _searched(
                table["id"].chunk(0), np.asarray(table["n"], np.int64), starts, np.asarray(lists.flatten()), np.asarray(often.flatten()), items, weights, n, words, k
            )

        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            if not batch.num_rows:
                continue
            kept.append(batch)
            room -= len(batch.column(2).flatten())
            if room <= 0:
                if (some := found()) is not None:
                    yield some
                kept, room = [], shard
        if kept and (some := found()) is not None:
            yield some

    out = StructType([StructField("item", IntegerType()), StructField("id", id_type), StructField("score", LongType())])
    return postings.mapInArrow(search, out)


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block: int = BLOCK,
    shard: int = SHARD,
) -> DataFrame:
    """The k documents of highest score for every item: the item's id, rank (from 1), the document's id, score.

    A term is a run of letters, digits and characters beyond ASCII, A-Z lower-cased. With N documents that have terms, L
    terms in all, n of the document, df documents that hold the term and tf times there, a term adds
    w * ((10^9 tf) div (1000 tf + 20 m)), w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + (50 n N) div L; an item's terms
    count once. Only scores above 0 are returned, equal ones by the smaller id.

    Null and empty texts have no terms and take no part, on either side. A document whose id is null is ranked after
    others of its score; rows with one id are as many documents, and rows with one item's id are as many items, each
    ranked by itself. Other columns are ignored; an empty table on either side gives no rows.
    """
    given = items.select(F.col(item_col).alias("given"), F.col(item_text).cast("string").alias("said")).filter("length(said) > 0")
    total = given.agg(F.sum(F.octet_length("said"))).first()[0] or 0
    blocks = max(1, -(-total // block))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # where a copy goes doesn't matter: it has its original's documents
    dealt = given.withColumn("part", F.pmod(F.xxhash64("given", "said"), F.lit(blocks)))
    out = []
    spark, schema = docs.sparkSession, StructType([StructField("item", IntegerType()), StructField("given", items.schema[item_col].dataType)])
    item_name, rank_name, id_name, score_name = _names(item_col, id_col)
    for b in range(blocks):
        rows = dealt.filter(F.col("part") == b).select("given", "said").collect()
        found = _block(read, [r["said"] for r in rows], k, shard)
        order = (F.desc("score"), F.col("id").asc_nulls_last())
        parts = max(1, -(-found.rdd.getNumPartitions() // MERGED))
        if parts > 1:
            salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(parts)))
            found = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).filter(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["given"]) for i, r in enumerate(rows)], schema)
        out.append(found.join(F.broadcast(names), "item").select("given", "rank", "id", "score"))
    return reduce(DataFrame.unionByName, out).toDF(item_name, rank_name, id_name, score_name)


def _names(item_col: str, id_col: str) -> tuple[str, str, str, str]:
    """The result's column names, none twice whatever their case."""
    taken = [item_col]
    for name in ("rank", id_col, "score"):
        while name.lower() in (t.lower() for t in taken):
            name = f"_{name}"
        taken.append(name)
    return tuple(taken)
