"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every vector is read as a sparse row of (term, weight) pairs, term being the component's place. Queries and candidates
are dealt into blocks by a hash of their id, and every pair of a query block and a candidate block is a task's work: the
postings of the candidates list, for each term, the rows that hold it with their weights; each term of the queries
scatters its weighted posting list into dense score arrays (one per query), and a partition selection keeps the k best
per query. The kept rows of all pairs of blocks merge through a ranking window per query.

Scale: nothing goes through the driver but two counts. A block has about `QUERY_BLOCK` or `CANDIDATE_BLOCK` rows, so what
a task holds is bounded, and at most k rows per query and candidate block leave it. Candidates are shuffled once per
query block and queries once per candidate block, which is what comparing all of them costs; larger blocks make that
less. Nothing is approximated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 65_536
#: Candidates whose score arrays are held at once.
STEP = 4096


def quantised(vector: str, scale: float):
    """Integers floor(scale * x), x as double; null if the vector, a component or its value isn't usable."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(v, lambda x: F.floor(x * F.lit(scale))))


def _dense(arrays: pa.Array) -> np.ndarray:
    """Rows of a list column side by side, short ones filled with zeros."""
    lengths = np.asarray(arrays.value_lengths(), np.int64)
    out = np.zeros((len(lengths), max([0, *lengths])), np.int64)
    if out.size:
        out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = np.asarray(arrays.flatten(), np.int64)
    return out


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, the first on a tie (all, if there are fewer)."""
    n = scores.shape[1]
    if n <= k:
        return np.broadcast_to(np.arange(n), scores.shape)
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    over = scores > least
    equal = scores == least
    room = k - over.sum(1, keepdims=True)
    return np.nonzero(over | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(len(scores), k)


def _accumulate(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Inner products of every query with every row of the block, term by term; an error if one may pass 64 bits."""
    terms = min(queries.shape[1], block.shape[1])
    largest = lambda x, t: max(int(x[:, t].max(initial=0)), -int(x[:, t].min(initial=0)))
    peak = sum(largest(queries, t) * largest(block, t) for t in range(terms))
    if peak >= 2**63:
        peak = int(np.abs(queries[:, :terms].astype(object)).dot(np.abs(block[:, :terms].astype(object)).T).max(initial=0))
        if peak >= 2**63:
            raise OverflowError("a score may pass 64 bits; give a smaller scale")
    kind = np.int32 if peak < 2**31 else np.int64
    scores = np.zeros((len(queries), len(block)), kind)
    for t in range(terms):
        weight, rows = queries[:, t].astype(kind), np.flatnonzero(block[:, t])
        holders = np.flatnonzero(weight)
        if not len(rows) or not len(holders):
            continue
        posting = block[rows, t].astype(kind)
        dense = len(rows) * 4 > len(block) * 3
        if dense:  # a list of nearly all rows is added whole
            posting, rows = block[:, t].astype(kind), slice(None)
        if len(holders) == len(queries) and dense:
            scores += weight[:, None] * posting
        else:
            for q in holders:
                scores[q, rows] += weight[q] * posting
    return scores


def top_k(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The k rows of highest integer inner product for each row that fulfils `is_query`.

    `is_query`: a Column over the id. Returns query_id, rank (from 1), the id column, score; ties go to the
    smaller id. Rows with the query's own id are no candidates of it. Rows with a null id, a null vector, or
    a null or non-finite component take no part; vectors of other lengths count as filled with zeros, empty
    ones score 0. An id that repeats stays as many candidates, and is searched for as often as its vectors
    differ, under the one query_id. Other columns are ignored; an empty table gives no rows. Scores are exact in 64
    bits; if the sizes of the components could take one beyond that, the search is an error.
    """
    usable = vectors.select(
        F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v")
    ).filter("id is not null and v is not null")
    queries = usable.filter(is_query(F.col("id"))).distinct()
    n, cores = usable.count(), usable.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-queries.count() // query_block))
    c_blocks = max(1, -(-n // candidate_block), min(cores, -(-n // STEP)))
    block = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row = F.monotonically_increasing_id()
    asked = queries.select(block(q_blocks).alias("q"), every(c_blocks).alias("c"), "id", "v")
    given = usable.select(F.pmod(F.xxhash64("id", row), F.lit(c_blocks)).cast("int").alias("c"), "id", "v").select(every(q_blocks).alias("q"), "c", "id", "v")

    def search(asked: pa.Table, given: pa.Table) -> pa.Table:
        return _search(asked, given, k)

    found = asked.groupBy("q", "c").cogroup(given.groupBy("q", "c")).applyInArrow(search, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )


def _search(asked: pa.Table, given: pa.Table, k: int) -> pa.Table:
    """(query_id, id, score): the k best of `given` for each row of `asked`."""
    query_ids = np.asarray(asked["id"], np.int64)
    own = np.asarray(given["id"], np.int64)
    out = [(np.empty(0, np.int64),) * 3]
    if len(query_ids) and len(own):
        rows = _dense(asked["v"].combine_chunks())
        order = np.argsort(own, kind="stable")  # the first column of a tie has the smaller id
        own, block = own[order], _dense(given["v"].combine_chunks().take(pa.array(order)))
        for q in range(0, len(query_ids), 256):
            mine = query_ids[q : q + 256]
            ids = np.empty((len(mine), 0), np.int64)
            best, there = ids, np.empty((len(mine), 0), bool)
            for c in range(0, len(own), STEP):
                scores = _accumulate(rows[q : q + 256], block[c : c + STEP]).astype(np.int64)
                other = mine[:, None] != own[None, c : c + STEP]
                low = np.where(other, scores, np.iinfo(np.int64).min)
                at = _best(low, k)
                best, ids, there = (
                    np.hstack((x, y)) for x, y in ((best, np.take_along_axis(low, at, 1)), (ids, own[c : c + STEP][at]), (there, np.take_along_axis(other, at, 1)))
                )
                at = _best(best, k)
                best, ids, there = (np.take_along_axis(x, at, 1) for x in (best, ids, there))
            out.append((np.repeat(mine, there.sum(1)), ids[there], best[there]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), columns, strict=True)})
