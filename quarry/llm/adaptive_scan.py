"""Approximate nearest neighbours: an index of lists, scanned with adaptive numbers of dimensions.

Index: centroids are fitted by k-means on a bounded sample (`SAMPLE` rows); every row is put into the list of its nearest
centroid and turned by one random rotation, and the table of lists is written. After a rotation the squared distance in
the first d of D dimensions, times D / d, estimates the whole one, and how far it may be off is known.

Search: how many lists a query probes is measured, not assumed: a bounded sample of the queries is compared with all
rows, and the least number of nearest lists that hold `RECALL` of their true neighbours is taken. A query's nearest list
is scanned first; its k-th distance there bounds the scan of the others. In a list the rotated vectors lie in blocks of
columns; after each block a candidate is dropped if a test of the hypothesis that it is within the bound rejects it (the
estimate is over bound * (1 + EPS / sqrt(d))). Those that no test drops get their exact distance from the original vectors,
in double precision, so each score is exact and only a neighbour may be missed.

Scale: a list, however large, is dealt into pieces of twice a list's mean size and `PIECE` bytes at most, and queries into
blocks of `QUERY_BLOCK`; a task has one piece and one block. At most k rows leave it for a query. What comes to the driver is bounded: the samples, the
lists' sizes, and the neighbours of the sampled queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

#: Rows that the centroids are fitted on, and bytes of them, at most.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Lists at most; there are about as many as the root of the rows. Up to EXHAUSTIVE rows are one list.
LISTS, EXHAUSTIVE = 1024, 1000
#: Share of the true neighbours that the probed lists hold, over at most CALIBRATE queries.
RECALL, CALIBRATE = 0.96, 256
#: Looseness of the tests; at 2.1 one rejects a true neighbour about once in a thousand.
EPS = 2.1
COLUMNS = 16
PIECE, QUERY_BLOCK, STEP = 32 << 20, 4096, 1024
SEED = 12


def dense(arrays: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column side by side in double precision, filled with zeros up to `width`."""
    lengths = np.asarray(arrays.value_lengths(), np.int64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None, :] < lengths[:, None]] = np.asarray(arrays.flatten(), np.float64)
    return out


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means by Lloyd's steps; a centroid without rows stays where it is."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, found, 1)[:, 0]
        counts = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def nearest_lists(vectors: np.ndarray, means: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of every vector, nearest first."""
    out = np.empty((len(vectors), n), np.int64)
    for a in range(0, len(vectors), 1024):
        far = (means * means).sum(1) - 2 * vectors[a : a + 1024] @ means.T
        out[a : a + 1024] = far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


@dataclass
class Index:
    """`table`: list, deal (a random number of the row), id, v (the vector), r (the same, rotated)."""

    table: DataFrame
    means: np.ndarray
    sizes: np.ndarray
    width: int


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that have an id and a finite vector other than zero."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(~F.coalesce(bad, F.lit(True)), v).alias("v"))
    return rows.filter(F.col("id").isNotNull() & F.exists("v", lambda x: x != 0))


def build(rows: DataFrame, lists: int | None = None) -> Index:
    """The index of rows (id, v) as `usable` gives them, written in the shared folder."""
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = about["n"], about["width"] or 1
    if lists is None:
        lists = 1 if n <= EXHAUSTIVE else min(LISTS, round(n**0.5))
    most = min(SAMPLE, SAMPLE_BYTES // (8 * width), 64 * lists)
    row = F.monotonically_increasing_id()
    taken = rows.filter(F.abs(F.xxhash64("id", row)) < 2.0**63 * min(1.0, most / max(n, 1))).limit(2 * most).select("v").toArrow()
    sample = dense(taken["v"].combine_chunks(), width)
    means = centroids(sample, lists) if len(sample) else np.zeros((1, width))
    turn = rotation(width)

    def put(batches):
        for batch in batches:
            vectors = dense(batch.column(2), width)
            own = nearest_lists(vectors, means, 1)[:, 0]
            turned = pa.FixedSizeListArray.from_arrays(pa.array((vectors @ turn).astype(np.float32).ravel()), width).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(1), batch.column(0), batch.column(2), turned], ["list", "deal", "id", "v", "r"])

    given = rows.select("id", F.pmod(F.xxhash64("id", row), F.lit(2**31)).alias("deal"), "v")
    table = cut(given.mapInArrow(put, "list int, deal long, id long, v array<double>, r array<float>"))
    sizes = np.zeros(len(means), np.int64)
    for r in table.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row per list
        sizes[r["list"]] = r["n"]
    return Index(table, means, sizes, width)


def _best(distances: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, by (distance, id)."""
    if len(distances) > k:
        near = np.flatnonzero(distances <= np.partition(distances, k - 1)[k - 1])
    else:
        near = np.arange(len(distances))
    return near[np.lexsort((ids[near], distances[near]))[:k]]


def scan(query: np.ndarray, turned: np.ndarray, own: int, bound: float, ids: np.ndarray, vectors: np.ndarray, blocks: list[np.ndarray], k: int, counts: list | None = None):
    """(distances, ids) of at most k candidates within `bound`, nearest first; `blocks`: their rotated columns.

    `counts` gets how many components were read."""
    best, best_ids = np.empty(0), np.empty(0, np.int64)
    width, slack = len(query), 1e-9 * float(query @ query)
    for start in range(0, len(ids), STEP):
        alive = np.flatnonzero(ids[start : start + STEP] != own) + start
        at = 0
        if bound == np.inf and len(alive) > 4 * k:  # the first few make the bound
            head, alive = alive[: 4 * k], alive[4 * k :]
            far = np.sqrt(((vectors[head] - query) ** 2).sum(1))
            keep = _best(far, ids[head], k)
            best, best_ids = far[keep], ids[head][keep]
            bound = float(best[-1]) if len(best) == k else np.inf
        partial = np.zeros(len(alive))
        for block in blocks[:-1]:
            if bound == np.inf or not len(alive):
                break
            apart = block[alive] - turned[at : at + block.shape[1]]
            partial += np.einsum("ij,ij->i", apart, apart)
            at += block.shape[1]
            if counts is not None:
                counts.append(apart.size)
            kept = partial * (width / at) <= (bound * (1 + EPS / at**0.5)) ** 2 + slack
            alive, partial = alive[kept], partial[kept]
        far = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
        good = far <= bound
        far, found = np.concatenate((best, far[good])), np.concatenate((best_ids, ids[alive[good]]))
        keep = _best(far, found, k)
        best, best_ids = far[keep], found[keep]
        if len(best) == k:
            bound = min(bound, float(best[-1]))
    return best, best_ids


def _calibrated(index: Index, sample: list, k: int, recall: float) -> int:
    """How many nearest lists hold `recall` of the true k nearest of the sampled queries, compared with all rows."""
    if not sample or len(index.means) == 1:
        return len(index.means)
    queries = np.zeros((len(sample), index.width))
    for i, r in enumerate(sample):
        queries[i, : len(r["v"])] = r["v"]
    own, width = np.array([r["id"] for r in sample], np.int64), index.width

    def compare(batches):
        kept = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int32))] * len(queries)
        for batch in batches:
            lists, ids, vectors = np.asarray(batch.column(0)), np.asarray(batch.column(1)), dense(batch.column(2), width)
            norms = (vectors * vectors).sum(1)
            for i, q in enumerate(queries):
                far = np.where(ids == own[i], np.inf, norms - 2 * vectors @ q + q @ q)
                near = np.argpartition(far, min(k, len(far)) - 1)[:k] if len(far) > k else np.arange(len(far))
                near = near[far[near] < np.inf]
                exact, found, on = (np.concatenate(x) for x in zip(kept[i], (((vectors[near] - q) ** 2).sum(1), ids[near], lists[near]), strict=True))
                best = _best(exact, found, k)
                kept[i] = exact[best], found[best], on[best]
        far, ids, on = (np.concatenate(x) for x in zip(*kept, strict=True))
        place = np.repeat(np.arange(len(queries), dtype=np.int32), [len(x[0]) for x in kept])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(far), pa.array(ids), pa.array(on)], ["query", "far", "id", "list"])

    found = index.table.select("list", "id", "v").mapInArrow(compare, "query int, far double, id long, list int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
    true = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "list").collect()  # k rows a sampled query
    order = nearest_lists(queries, index.means, len(index.means))
    place = np.argsort(order, axis=1)
    needed = np.sort([place[r["query"], r["list"]] for r in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else len(index.means)


def search(index: Index, queries: DataFrame, k: int = 10, recall: float = RECALL, piece: int = PIECE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each of the distinct queries (id, v), rows of the query's own
    id left out."""
    about = queries.agg(F.count("*").alias("n")).first()
    repeats = queries.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    row = F.monotonically_increasing_id()
    part = F.abs(F.xxhash64("id", "v")) < 2.0**63 * min(1.0, CALIBRATE / max(about["n"], 1))
    sample = queries.filter(part).limit(2 * CALIBRATE).collect()
    probes, means, sizes, width = _calibrated(index, sample, k, recall), index.means, index.sizes, index.width
    rows = max(256, min(piece // (8 * width), 2 * int(sizes.sum()) // len(sizes)))
    pieces = np.maximum(1, -(-sizes // rows))
    blocks = max(1, -(-about["n"] // query_block))
    # rows of the query's own id, as many as there are, are no candidates: the lists must hold k others
    others = k + repeats

    def probe(batches):
        for batch in batches:
            order = nearest_lists(dense(batch.column(1), width), means, len(means))
            enough = (np.cumsum(sizes[order], axis=1) < others).sum(1) + 1
            lists = [o[: max(probes, n)] for o, n in zip(order, enough, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[sizes[x] > 0].astype(np.int32) for x in lists], pa.list_(pa.int32()))], ["id", "v", "lists"])

    asked = queries.select("id", "v").mapInArrow(probe, "id long, v array<double>, lists array<int>")
    asked = cut(asked.withColumns({"query": row, "block": F.pmod(F.xxhash64("id", row), F.lit(blocks)).cast("int")}))
    dealt = asked.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(pieces)], "list int, pieces int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    given = index.table.join(F.broadcast(dealt), "list").withColumn("piece", F.pmod("deal", "pieces").cast("int"))
    given = given.select("list", "piece", every(F.lit(blocks)).alias("block"), "id", "v", "r")
    turn = rotation(width)

    def look(asked: pa.Table, given: pa.Table) -> pa.Table:
        out = []
        if len(asked) and len(given):
            ids = np.asarray(given["id"].combine_chunks(), np.int64)
            vectors = dense(given["v"].combine_chunks(), width)
            turned = np.asarray(given["r"].combine_chunks().flatten(), np.float32).reshape(-1, width)
            columns = [np.ascontiguousarray(turned[:, a : a + COLUMNS], np.float64) for a in range(0, width, COLUMNS)]
            wanted = dense(asked["v"].combine_chunks(), width)
            rotated = wanted @ turn
            bounds = [np.inf if b is None else b for b in asked["bound"].to_pylist()]
            for i, (key, own) in enumerate(zip(asked["query"].to_pylist(), asked["id"].to_pylist(), strict=True)):
                far, found = scan(wanted[i], rotated[i], own, bounds[i], ids, vectors, columns, k)
                out.append((np.full(len(far), key), np.full(len(far), own), found, far))
        parts = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(x.astype(t.to_pandas_dtype()), t) for n, x, t in zip(("query", "query_id", "id", "score"), parts, kinds, strict=True)})

    def scanned(probed: DataFrame, given: DataFrame) -> DataFrame:
        sent = probed.join(F.broadcast(dealt), "list").select("query", "id", "v", "bound", "list", every(F.col("pieces")).alias("piece"), "block")
        keys = ["list", "piece", "block"]
        return sent.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(look, "query long, query_id long, id long, score double")

    first = cut(scanned(asked.select("*", F.col("lists")[0].alias("list"), F.lit(None).cast("double").alias("bound")), given))
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    kth = first.withColumn("rank", place).filter(F.col("rank") == k).select("query", F.col("score").alias("bound"))
    rest = asked.filter(F.size("lists") > 1).join(kth, "query", "left")
    rest = rest.withColumn("list", F.explode(F.slice("lists", 2, len(means))))
    found = first.unionByName(scanned(rest, given))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """The k nearest found, by Euclidean distance, for each row that fulfils `is_query` (a Column over the id): query_id,
    rank (from 1), the id column, score.

    Rows with the query's own id are no candidates of it; ties go to the smaller id. Rows with a null id, a null or zero
    vector, or a null or non-finite component take no part; shorter vectors count as filled with zeros. An id that
    repeats stays as many candidates, and is searched for as often as its vectors differ, under the one query_id.
    Other columns are ignored; an empty table gives no rows. With k candidates or fewer all are returned.
    """
    rows = usable(vectors, id_col, vector_col)
    index = build(rows)
    name = id_col if id_col.lower() not in ("query_id", "rank", "score") else f"_{id_col}"
    return search(index, rows.filter(is_query(F.col("id"))).distinct(), k, **how).withColumnRenamed("id", name)
