"""A lexical index that is kept current and read by words.

An index is a folder of Parquet tables. Chunks are written as segments, which never change:

cut                       chunks and blocks of a write that is under way
written/segment=s/kind=0  a row per chunk: cell, place in it, id, numbers of words by weight, and what else is kept of it
postings/segment=s        a row per word and cell, in folders by a hash of the word and sorted by it: the places of the chunks
                          that hold it and how often, and the most that it can add to a score there
dead/version=v            chunks that are gone: segment, cell, place, numbers of words
versions/version=v        the segments of that version with their totals; what it doesn't name isn't read

A cell is a set of at most `CELL` chunks, of nearly one length, that one task has written; it is the same for all words, so
that the cells' bounds are sums over the words, and it stays what it is when segments merge. A search for the k best
reads the small columns of its words' cells, scores the cells of highest bound, and then only those whose bound reaches
the k-th score found. A change writes one segment with the new chunks and names the old ones dead; `merge` puts segments
of one size together from their postings, without the dead and without reading texts.

One writer at a time. A write that fails leaves files that no version names; the next one writes over them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quarry.functions import text as T
from quarry.operators.retrieval import DIGITS, FIELD_WEIGHTS, query_words
from quarry.sources.store import known_folder
from quarry.streaming.windows import once, shared_folder

CELL = 1024
#: Chunks and words that a task sorts by length before it cuts them into cells.
SORTED, SORTED_WORDS = 8 * CELL, 8_000_000
#: Words of a folder of postings, folders at most, and words of one file of a folder.
FOLDER_WORDS, FOLDERS, FILE_WORDS = 2_000_000, 4096, 16_000_000
#: Cells that a search scores before it knows a threshold, and that a task scores for many questions.
FIRST, FIRST_MANY = 32, 32
#: Of these, the cells that it scores first.
AT_FIRST = 4
#: Rows that a task gives for a block of questions.
ROWS_GIVEN = 4_000_000
#: Words of many questions that are sent to all tasks that read postings.
WORDS_SENT = 200_000
#: Segments of one size that are merged, and the base of the sizes.
MERGED = 4
#: A score's bound is sure beyond its rounding.
SURE = 1e-6


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _hashed(of: Column, parts: Column | int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(parts) if isinstance(parts, int) else parts).cast("int")


@dataclass(frozen=True)
class Version:
    """What an index holds at one time; `segments` are rows of `versions`."""

    spark: SparkSession
    path: str
    number: int
    segments: tuple
    weights: tuple[str, ...]

    @property
    def docs(self) -> int:
        return sum(s["docs"] for s in self.segments)

    def words(self, weight: str) -> int:
        return sum(s[f"n_{weight}"] for s in self.segments)

    def _table(self, name: str, below: str = "") -> DataFrame | None:
        """A table's rows of the segments; None if it has no file with rows."""
        if not self.segments:
            return None
        folders = [f"{self.path}/{name}/segment={s['segment']}{below}" for s in self.segments]
        try:
            return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*folders)
        except AnalysisException as e:
            if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
            return None

    def chunks(self) -> DataFrame | None:
        """All chunks, the dead ones too: segment, cell, ord, id, numbers of words, what is kept."""
        rows = self._table("written", "/kind=0")
        return None if rows is None else rows.drop("kind", *_block_columns(self.weights))

    def dead(self) -> DataFrame | None:
        """(segment, cell, ord) of chunks that are gone; None if there are none."""
        if not any(s["dead"] for s in self.segments):
            return None
        first = self.segments[0]["dead_from"]
        rows = self.spark.read.parquet(f"{self.path}/dead").filter(F.col("version").between(first, self.number))
        return rows.filter(F.col("segment").isin([s["segment"] for s in self.segments])).drop("version")

    def live(self) -> DataFrame | None:
        """The chunks that the index holds."""
        rows, gone = self.chunks(), self.dead()
        return rows if rows is None or gone is None else rows.join(gone.select("cell", "ord"), ["cell", "ord"], "left_anti")

    def blocks(self, wanted: list[str]) -> DataFrame | None:
        """Postings of the wanted words: of the folders that their hashes name, the row groups that hold them."""
        rows = self._table("postings")
        if rows is None or not wanted:
            return None
        sizes = sorted({s["folders"] for s in self.segments})
        # hashed on the driver's own session, so that the folders are constants of the scan
        named = self.spark.range(1).select(*[_hashed(F.lit(t), n).alias(f"f{n}_{i}") for n in sizes for i, t in enumerate(wanted)]).first()
        folders = {n: sorted({named[f"f{n}_{i}"] for i in range(len(wanted))}) for n in sizes}
        there = [(F.col("segment") == s["segment"]) & F.col("bucket").isin(folders[s["folders"]]) for s in self.segments]
        return rows.filter(reduce(lambda a, b: a | b, there) & F.col("tok").isin(wanted))


def current(spark: SparkSession, path: str) -> Version:
    """The newest version; an index that has none yet is empty."""
    try:
        written = spark.read.option("mergeSchema", True).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return Version(spark, path, 0, (), ())
    last = written.agg(F.max("version")).first()[0]
    rows = [r.asDict() for r in written.filter(F.col("version") == last).collect()]  # a row per segment
    weights = tuple(sorted(c[2:] for c, v in rows[0].items() if c.startswith("n_") and v is not None))
    return Version(spark, path, last, tuple(sorted((r for r in rows if r["segment"] > 0), key=lambda r: r["segment"])), weights)


def _commit(before: Version, segments: list[dict], weights: list[str]) -> Version:
    """Write the next version. One without segments is a row of segment 0."""
    number = before.number + 1
    rows = segments or [{"segment": 0, "docs": 0, "dead": 0, "folders": 1, "dead_from": number, **{f"n_{w}": 0 for w in weights}}]
    names = ["segment", "docs", "dead", "folders", "dead_from", *[f"n_{w}" for w in weights]]
    schema = ", ".join(f"{n} long" for n in names)
    out = before.spark.createDataFrame([[r[n] for n in names] for r in rows], schema)
    out.coalesce(1).write.mode("overwrite").parquet(f"{before.path}/versions/version={number}")
    return current(before.spark, before.path)


def _next_segment(before: Version) -> int:
    """A number that no version has named."""
    if before.number == 0:
        return 1
    return before.spark.read.parquet(f"{before.path}/versions").agg(F.max("segment")).first()[0] + 1


def _block_columns(weights) -> list[str]:
    return ["tok", "ords", *[f"tf_{w}" for w in weights], "peak", *[f"short_{w}" for w in weights]]


def _block_types(weights) -> list[tuple[str, str]]:
    return [(c, "string" if c == "tok" else "double" if c == "peak" else "int" if c.startswith("short") else "array<int>") for c in _block_columns(weights)]


def _celled(rows: DataFrame, weights: list[str], number: int, only: list[str] | None = None) -> DataFrame:
    """Chunks (id, words_<weight>, what is kept) as rows of two kinds: chunks (0) with cell, ord and n_<weight>, and the blocks
    (1) of each word of a cell with ords, tf_<weight> (null where it doesn't stand), peak and short_<weight>. `only`: the words
    that get blocks."""
    wanted = None if only is None else pa.array(only, pa.string())
    kept = [f for f in rows.schema.fields if not f.name.startswith("words_")]
    ints, blocks = ArrayType(IntegerType()), _block_columns(weights)
    types = {"tok": StringType(), "ords": ints, "peak": DoubleType(), **{f"tf_{w}": ints for w in weights}, **{f"short_{w}": IntegerType() for w in weights}}
    head = [StructField("kind", IntegerType()), StructField("cell", LongType()), StructField("ord", IntegerType())]
    schema = StructType([*head, *[StructField(f.name, f.dataType) for f in kept], *[StructField(f"n_{w}", IntegerType()) for w in weights], *[StructField(c, types[c]) for c in blocks]])
    names = schema.names
    arrow = {"tok": pa.string(), "ords": pa.list_(pa.int32()), "peak": pa.float64(), **{f"tf_{w}": pa.list_(pa.int32()) for w in weights}, **{f"short_{w}": pa.int32() for w in weights}}

    def listed(values: np.ndarray, starts: np.ndarray, there: np.ndarray) -> pa.Array:
        """The values of each block as a list, null where none is there."""
        sizes = np.where(there, np.diff(starts, append=len(values)), 0)
        whose = np.repeat(there, np.diff(starts, append=len(values)))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(values[whose].astype(np.int32)), mask=pa.array(~there))

    def cell_rows(part: pa.Table, cell: int):
        lists = [part[f"words_{w}"].combine_chunks() for w in weights]
        lengths = [np.asarray(part[f"n_{w}"].combine_chunks(), np.int64) for w in weights]
        held = [np.asarray(x.value_lengths(), np.int64) for x in lists]
        n = part.num_rows
        own = {"kind": pa.array(np.zeros(n, np.int32)), "cell": pa.array(np.full(n, cell)), "ord": pa.array(np.arange(n, dtype=np.int32))}
        own |= {f.name: part[f.name].combine_chunks() for f in kept} | {f"n_{w}": pa.array(x.astype(np.int32)) for w, x in zip(weights, lengths, strict=True)}
        yield pa.RecordBatch.from_arrays([own[c] if c in own else pa.nulls(n, arrow[c]) for c in names], names)
        flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
        if not len(flat):
            return
        owner = np.concatenate([np.repeat(np.arange(n), x) for x in held])
        key, place = np.unique(np.asarray(flat.indices, np.int64) * n + owner, return_inverse=True)
        edges = np.cumsum([0, *[x.sum() for x in held]])
        often = [np.bincount(place[a:b], minlength=len(key)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        code, ords = key // n, key % n
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        score = sum(FIELD_WEIGHTS[w] * x for w, x in zip(weights, often, strict=True)) / (1 + np.log(1.0 + sum(lengths)[ords]))
        count = len(starts)
        made = {"kind": pa.array(np.ones(count, np.int32)), "cell": pa.array(np.full(count, cell)), "tok": flat.dictionary.take(pa.array(code[starts]))}
        made |= {"ords": listed(ords, starts, np.ones(count, bool)), "peak": pa.array(np.maximum.reduceat(score, starts))}
        for w, x, size in zip(weights, often, lengths, strict=True):
            made |= {f"tf_{w}": listed(x, starts, np.maximum.reduceat(x, starts) > 0), f"short_{w}": pa.array(np.minimum.reduceat(size[ords], starts).astype(np.int32))}
        kinds = {f.name: part.schema.field(f.name).type for f in kept} | {"ord": pa.int32()} | {f"n_{w}": pa.int32() for w in weights}
        yield pa.RecordBatch.from_arrays([made[c] if c in made else pa.nulls(count, kinds.get(c, arrow.get(c))) for c in names], names)

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        """With the numbers of words of each chunk, and of the words only those that get blocks."""
        made = {f.name: batch.column(f.name) for f in kept}
        for w in weights:
            lists = batch.column(f"words_{w}")
            sizes, flat = np.asarray(lists.value_lengths(), np.int64), lists.flatten()
            made[f"n_{w}"] = pa.array(sizes.astype(np.int32))
            if wanted is not None:
                there = pc.is_in(flat, value_set=wanted)
                before = np.concatenate(([0], np.cumsum(np.asarray(there))))[np.concatenate(([0], np.cumsum(sizes)))]
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), flat.filter(there))
            made[f"words_{w}"] = lists
        return pa.RecordBatch.from_pydict(made)

    def run(batches):
        first, cells, held, size, words = (number << 40) + (TaskContext.get().partitionId() << 20), 0, [], 0, 0

        def cut():
            nonlocal cells
            table = pa.Table.from_batches(held)
            total = sum(np.asarray(table[f"n_{w}"].combine_chunks(), np.int64) for w in weights)
            order = np.argsort(total, kind="stable")
            for a in range(0, len(order), CELL):
                yield from cell_rows(table.take(pa.array(order[a : a + CELL])), first + cells)
                cells += 1

        for batch in map(counted, batches):
            held.append(batch)
            size, words = size + batch.num_rows, words + sum(len(batch.column(f"words_{w}").flatten()) for w in weights)
            if size >= SORTED or words >= SORTED_WORDS:
                yield from cut()
                held, size, words = [], 0, 0
        if size:
            yield from cut()

    return rows.mapInArrow(run, schema)


def _put(before: Version, number: int, blocks: DataFrame, weights: list[str], words: int | None = None) -> dict:
    """Write a segment's postings, from blocks; its chunks have been written. `words`: how many the blocks hold, if not all that
    the chunks have."""
    spark, path = before.spark, before.path
    chunks = spark.read.parquet(f"{path}/written/segment={number}/kind=0")
    sums = chunks.agg(F.count("*").alias("docs"), *[F.coalesce(F.sum(f"n_{w}"), F.lit(0)).alias(f"n_{w}") for w in weights]).first().asDict()
    words = sum(sums[f"n_{w}"] for w in weights) if words is None else words
    folders = max(1, min(FOLDERS, -(-words // FOLDER_WORDS)))
    files = max(1, -(-words // (folders * FILE_WORDS)))
    stats = {"n": F.size("ords")}
    for w in weights:
        stats |= {f"most_{w}": F.coalesce(F.array_max(f"tf_{w}"), F.lit(0)), f"df_{w}": F.coalesce(F.size(F.filter(f"tf_{w}", lambda x: x > 0)), F.lit(0))}
    dealt = blocks.select("cell", *_block_columns(weights)).withColumn("bucket", _hashed(F.col("tok"), folders)).repartition(folders * files, "bucket", _hashed(F.col("cell"), files))
    sorted_ = dealt.withColumns(stats).sortWithinPartitions("bucket", "tok", "cell")
    sorted_.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/segment={number}")
    return {"segment": number, "dead": 0, "folders": folders, "dead_from": before.segments[0]["dead_from"] if before.segments else before.number + 1, **sums}


def _removed(before: Version, gone: DataFrame, version: int, weights: list[str]) -> list[dict]:
    """The version's segments without the chunks of ids `gone`, which are written as dead."""
    live = before.live()
    if live is None:
        return [dict(s) for s in before.segments]
    sizes = [f"n_{w}" for w in weights]
    target = f"{before.path}/dead/version={version}"
    lost = live.join(gone.select(F.col(gone.columns[0]).alias("id")).distinct(), "id", "left_semi").select("segment", "cell", "ord", *sizes)
    lost.write.mode("overwrite").parquet(target)
    of = before.spark.read.schema(lost.schema).parquet(target).groupBy("segment").agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in sizes])
    less = {r["segment"]: r for r in of.collect()}  # a row per segment
    out = []
    for s in map(dict, before.segments):
        if (r := less.get(s["segment"])) is not None:
            s |= {"dead": s["dead"] + r["docs"], "docs": s["docs"] - r["docs"], **{c: s[c] - r[c] for c in sizes}}
        if s["docs"]:
            out.append(s)
    return out


def change(spark: SparkSession, path: str, chunks: DataFrame | None, fields: dict[str, tuple[Column, str]], gone: DataFrame | None = None, id_col: str = "id", keep: list[str] = (), only: list[str] | None = None) -> Version:
    """The next version: `chunks` are in it in place of those with their ids, and chunks whose ids are in the first column of
    `gone` are not. `fields`: name -> (text, weight); the weights are the same in all versions. Ids are unique within
    `chunks`; null texts have no words. `keep`: columns of chunks that the index keeps. `only`: the words that the chunks can
    be found by, if not all; their numbers of words count all."""
    before = current(spark, path)
    weights = sorted({w for _, w in fields.values()})
    if before.number and tuple(weights) != before.weights:
        raise ValueError(f"the index has the weights {before.weights}")
    number = _next_segment(before)
    ids = [x for x in (gone if gone is None else gone.select(gone.columns[0]), None if chunks is None else chunks.select(F.col(id_col))) if x is not None]
    segments = [dict(s) for s in before.segments]
    if ids and segments:
        segments = _removed(before, reduce(DataFrame.union, ids), before.number + 1, weights)
    if chunks is not None:
        of = lambda weight: F.flatten(F.array(*[T.words(c) for c, w in fields.values() if w == weight]))
        rows = chunks.select(F.col(id_col).alias("id"), *keep, *[of(w).alias(f"words_{w}") for w in weights])
        # both kinds in one file: a writer by kind would sort all that a task makes
        cut, celled = f"{path}/cut", _celled(rows, weights, number, only)
        celled.write.mode("overwrite").parquet(cut)
        made = spark.read.schema(celled.schema).parquet(cut)
        made.filter("kind = 0").drop("kind", *_block_columns(weights)).write.mode("overwrite").parquet(f"{path}/written/segment={number}/kind=0")
        blocks = made.filter("kind = 1").drop("kind")
        words = None if only is None else blocks.agg(F.coalesce(F.sum(F.size("ords")), F.lit(0))).first()[0]
        new = _put(before, number, blocks, weights, words)
        segments += [new] * bool(new["docs"])
        spark.range(0).write.mode("overwrite").parquet(cut)  # the blocks are in the postings now
    return _commit(before, segments, weights)


def write(chunks: DataFrame, fields: dict[str, tuple[Column, str]], path: str, id_col: str = "id", mode: str = "overwrite", keep: list[str] = ()) -> Version:
    """An index of `chunks`: all that it holds, or with mode "append" in place of those with their ids."""
    spark = chunks.sparkSession
    if mode == "append":
        return change(spark, path, chunks, fields, id_col=id_col, keep=keep)
    before = current(spark, path)
    if before.number:
        _commit(before, [], sorted({w for _, w in fields.values()}))
    return change(spark, path, chunks, fields, id_col=id_col, keep=keep)


def remove(spark: SparkSession, path: str, gone: DataFrame) -> Version:
    """The next version, without the chunks whose ids are in the first column of `gone`."""
    before = current(spark, path)
    return _commit(before, _removed(before, gone, before.number + 1, list(before.weights)), list(before.weights))


def to_merge(segments: tuple, most: int = MERGED) -> list[int]:
    """Segments of the smallest size (a power of `most`) that has as many as that, and those of which half is dead."""
    by: dict[int, list[int]] = {}
    for s in segments:
        size, n = 0, s["docs"]
        while n >= most:
            size, n = size + 1, n // most
        by.setdefault(size, []).append(s["segment"])
    full = min((size for size, held in by.items() if len(held) >= most), default=None)
    rotten = [s["segment"] for s in segments if s["dead"] > s["docs"]]
    return sorted({*rotten, *(by[full] if full is not None else [])})


def merge(spark: SparkSession, path: str, most: int = MERGED, every: bool = False) -> Version:
    """The next version, with the segments that `to_merge` names (or all) as one, without their dead chunks. Texts are not
    read; the same version if there is nothing to merge."""
    before = current(spark, path)
    chosen = [s["segment"] for s in before.segments] if every else to_merge(before.segments, most)
    if not chosen or (len(chosen) == 1 and not any(s["dead"] for s in before.segments if s["segment"] in chosen)):
        return before
    part = Version(spark, path, before.number, tuple(s for s in before.segments if s["segment"] in chosen), before.weights)
    weights, number = list(before.weights), _next_segment(before)
    part.live().drop("segment").write.mode("overwrite").parquet(f"{path}/written/segment={number}/kind=0")
    blocks, lost = part._table("postings"), part.dead()
    if blocks is None:
        blocks = spark.read.parquet(f"{path}/written/segment={number}/kind=0").select("cell", *[F.lit(None).cast(t).alias(c) for c, t in _block_types(weights)]).filter(F.lit(False))
    elif lost is not None:
        zipped = F.arrays_zip("ords", *[f"tf_{w}" for w in weights])
        left = blocks.withColumns({f"tf_{w}": F.coalesce(f"tf_{w}", F.transform("ords", lambda _: F.lit(0))) for w in weights})
        gone = lost.groupBy("cell").agg(F.collect_list("ord").alias("gone"))  # a cell's places, as one sign for each place
        alive = F.transform(F.sequence(F.lit(0), F.lit(CELL - 1)), lambda i: ~F.array_contains("gone", i))
        left = left.join(F.broadcast(once(gone.select("cell", alive.alias("alive")))), "cell", "left")
        left = left.withColumn("rows", F.when(F.col("alive").isNull(), zipped).otherwise(F.filter(zipped, lambda x: F.get("alive", x["ords"]))))
        blocks = left.filter("size(rows) > 0").withColumns({c: F.col(f"rows.{c}") for c in ("ords", *[f"tf_{w}" for w in weights])})
    new = _put(before, number, blocks, weights)
    rest = [dict(s) for s in before.segments if s["segment"] not in chosen]
    version, gone = before.number + 1, before.dead()
    if gone is not None:  # those that still count begin the list anew
        left = gone.filter(~F.col("segment").isin(chosen))
        left.write.mode("overwrite").parquet(f"{path}/dead/version={version}")
        rest = [s | {"dead_from": version} for s in rest]
    return _commit(before, rest + [new | {"dead_from": rest[0]["dead_from"] if rest else version}] * bool(new["docs"]), weights)


def _nothing(spark: SparkSession, version: Version) -> DataFrame:
    """(id, score) without rows, ids of the index's type."""
    docs = version.chunks()
    kind = "long" if docs is None else docs.schema["id"].dataType.simpleString()
    return spark.createDataFrame([], f"id {kind}, score double")


def _best(found: DataFrame, k: int | None) -> DataFrame:
    return found if k is None else found.orderBy(F.desc("score"), "id").limit(k)


def _by_bound(version: Version, blocks: DataFrame, bounds: DataFrame, scored, k: int | None, read: dict | None) -> DataFrame:
    """Scores of all chunks of the cells in `bounds` (cell, bound), or of enough of them for the k best.

    `scored`: (blocks, chunks) -> (id, score). `read` gets the numbers of cells that are scored and that there are."""
    chunks = version.live().select("cell", "ord", "id", *[f"n_{w}" for w in version.weights])
    if k is None:
        return scored(blocks.join(bounds.select("cell"), "cell", "left_semi"), chunks)
    best = bounds.orderBy(F.desc("bound"), "cell").limit(FIRST).collect()  # at most FIRST rows
    named = F.col("cell").isin([r["cell"] for r in best])  # constants of the scans, which skip pages by them
    first = scored(blocks.filter(named), chunks.filter(named))
    top = _best(first, k).collect()  # k rows
    least = top[-1]["score"] if len(top) == k else 0.0
    others = bounds.filter(~named & (F.col("bound") >= least - SURE)).select("cell")
    if read is not None:
        read |= {"cells": len(best) + others.count(), "of": bounds.count()}
    rest = scored(blocks.join(F.broadcast(others), "cell", "left_semi"), chunks) if len(best) == FIRST else first.filter(F.lit(False))
    return version.spark.createDataFrame([tuple(r) for r in top], first.schema).unionByName(rest)


def _rows(blocks: DataFrame, weights, *more: str) -> DataFrame:
    """(more, cell, tok, ord, tf_<weight>) of the chunks in blocks."""
    whole = blocks.withColumns({f"tf_{w}": F.coalesce(f"tf_{w}", F.transform("ords", lambda _: F.lit(0))) for w in weights})
    zipped = F.inline(F.arrays_zip("ords", *[f"tf_{w}" for w in weights]))
    return whole.select(*more, "cell", "tok", zipped).withColumnRenamed("ords", "ord")


def _weighed(rows: DataFrame, chunks: DataFrame, weights, need, *more: str) -> DataFrame:
    """(more, id, score) of the chunks that hold as many words as needed."""
    held = rows.groupBy(*more, "cell", "ord").agg(F.count("*").alias("held"), *[F.sum(f"tf_{w}").alias(f"t_{w}") for w in weights]).filter(F.col("held") == need)
    score = _add([F.lit(FIELD_WEIGHTS[w]) * F.col(f"t_{w}") for w in weights]) / (1 + F.log(1.0 + _add([F.col(f"n_{w}") for w in weights])))
    return held.join(chunks, ["cell", "ord"]).select(*[c for c in more if c != "need"], "id", F.round(score, DIGITS).alias("score"))


def search(spark: SparkSession, path: str, query: str, k: int | None = None, read: dict | None = None) -> DataFrame:
    """(id, score) as `retrieval.text_search` gives them: the chunks that hold all words of the query, or the k best."""
    version, wanted = current(spark, path), sorted(set(query_words(query)))
    blocks = version.blocks(wanted)
    if blocks is None:
        return _nothing(spark, version)
    bounds = blocks.groupBy("cell").agg(F.count("*").alias("held"), F.sum("peak").alias("bound")).filter(F.col("held") == len(wanted))
    scored = lambda some, chunks: _weighed(_rows(some, version.weights), chunks, version.weights, F.lit(len(wanted)))
    return _best(_by_bound(version, blocks, bounds, scored, k, read), k)


def _frequencies(version: Version, blocks: DataFrame, weight: str) -> dict[str, int]:
    """In how many chunks each word stands in fields of a weight: what the blocks say, less the dead of their cells."""
    counted = blocks.groupBy("tok").agg(F.sum(f"df_{weight}").alias("df"))
    gone = version.dead()
    if gone is not None:
        held = _rows(blocks.join(gone.select("cell").distinct(), "cell", "left_semi"), version.weights).filter(F.col(f"tf_{weight}") > 0)
        lost = held.join(gone.select("cell", "ord"), ["cell", "ord"], "left_semi").groupBy("tok").agg(F.count("*").alias("lost"))
        counted = counted.join(lost, "tok", "left").select("tok", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
    return {r["tok"]: r["df"] for r in counted.filter("df > 0").collect()}  # a row per word of the query


def bm25(spark: SparkSession, path: str, query: str, weight: str, k1: float = 1.2, b: float = 0.75, k: int | None = None, read: dict | None = None) -> DataFrame:
    """(id, score) of the chunks whose fields of one weight hold any word of the query, by BM25, or of the k best."""
    version, wanted = current(spark, path), sorted(set(query_words(query)))
    blocks = version.blocks(wanted)
    if blocks is None:
        return _nothing(spark, version)
    blocks = blocks.filter(F.col(f"df_{weight}") > 0)
    mean = version.words(weight) / version.docs if version.docs else 0.0
    idf = F.lit(0.0)
    for word, df in _frequencies(version, blocks, weight).items():
        idf = F.when(F.col("tok") == word, F.log(F.lit(1 + (version.docs - df + 0.5) / (df + 0.5)))).otherwise(idf)

    def part(tf: Column, n: Column) -> Column:
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / F.lit(mean or 1.0)))

    # more of a word and fewer words both raise a score
    bounds = blocks.groupBy("cell").agg(F.sum(part(F.col(f"most_{weight}"), F.col(f"short_{weight}"))).alias("bound"))

    def scored(some: DataFrame, chunks: DataFrame) -> DataFrame:
        rows = _rows(some, version.weights).filter(F.col(f"tf_{weight}") > 0).join(chunks, ["cell", "ord"])
        return rows.groupBy("cell", "ord", "id").agg(F.round(F.sum(part(F.col(f"tf_{weight}"), F.col(f"n_{weight}"))), DIGITS).alias("score")).filter("score > 0").select("id", "score")

    return _best(_by_bound(version, blocks, bounds, scored, k, read), k)


def _answers(weights: tuple[str, ...], k: int, empty: pa.Table):
    """(questions, blocks) -> tallies of the k best chunks of some cells, for each question of a block.

    `questions`: q, ws. `blocks`: those of the words asked, and a row without a word for each cell with its chunks' places,
    ids and lengths (as the first weight's counts)."""
    firsts = [f"tf_{w}" for w in weights]

    def best(questions: pa.Table, blocks: pa.Table) -> pa.Table:
        if not len(questions) or not len(blocks):
            return empty
        words = blocks["tok"].combine_chunks()
        own = np.asarray(words.is_null())
        codes = words.dictionary_encode()
        seen = np.asarray(codes.indices.fill_null(-1), np.int64)
        cell, number = np.unique(np.asarray(blocks["cell"]), return_inverse=True)
        order = np.lexsort((number, seen))  # words by code, those of a word by cell; rows of cells come first
        rows = blocks.take(pa.array(order))
        seen, number = seen[order], number[order]
        places = rows["ords"].combine_chunks()
        sizes = np.asarray(places.value_lengths(), np.int64)
        at = np.asarray(places.flatten(), np.int64) + np.repeat(number * CELL, sizes)
        often = []
        for name in firsts:
            lists = rows[name].combine_chunks()
            counts = np.zeros(len(at), np.int64)
            counts[np.repeat(np.asarray(lists.is_valid()), sizes)] = np.asarray(lists.flatten(), np.int64)
            often.append(counts)
        n_own = int(sizes[: own.sum()].sum())
        length = np.full(len(cell) * CELL, -1, np.int64)  # -1: no chunk, or a dead one
        length[at[:n_own]] = often[0][:n_own]
        ids = rows["ids"].combine_chunks().flatten()
        which, rank = np.zeros(len(length), np.int64), np.empty(n_own, np.int64)
        which[at[:n_own]] = np.arange(n_own)
        rank[np.asarray(pc.sort_indices(ids), np.int64)] = np.arange(n_own)
        edges, first = np.concatenate(([0], np.cumsum(sizes))), np.searchsorted(seen, np.arange(len(codes.dictionary) + 1))
        # what a posting adds to a score, but for rounding; 0 for the dead
        value = sum(FIELD_WEIGHTS[w] * x for w, x in zip(weights, often, strict=True)) * np.where(length < 0, 0, 1 / (1 + np.log1p(np.maximum(length, 0))))[at]
        peak = np.maximum.reduceat(value, edges[:-1])
        peaks = np.zeros((len(codes.dictionary), len(cell)))
        peaks[seen[first[0] :], number[first[0] :]] = peak[first[0] :]
        asked = questions["ws"].combine_chunks()
        cuts = np.concatenate(([0], np.cumsum(np.asarray(asked.value_lengths(), np.int64))))
        code = np.asarray(pc.index_in(asked.flatten(), value_set=codes.dictionary).fill_null(-1), np.int64)
        whole = np.minimum.reduceat(code, cuts[:-1]) >= 0

        def meet(chosen: np.ndarray, others: np.ndarray) -> np.ndarray:
            """Postings of the chunks that hold a word, in the rows chosen of it, and all others: a row for each word."""
            spots = np.concatenate([np.arange(edges[r], edges[r + 1]) for r in chosen])[None]
            spots = spots[:, value[spots[0]] > 0]
            for c in others:
                a, b = edges[first[c]], edges[first[c + 1]]
                found = at[spots[0]]
                spot = np.minimum(np.searchsorted(at[a:b], found), b - a - 1) + a
                spots = np.vstack((spots, spot))[:, at[spot] == found]
            return spots

        out = []
        for i in np.flatnonzero(whole):
            mine = code[cuts[i] : cuts[i + 1]]
            rare, *others = mine[np.argsort(edges[first[mine + 1]] - edges[first[mine]], kind="stable")]
            chosen = np.arange(first[rare], first[rare + 1])
            bounds = np.vstack((peak[chosen], peaks[others][:, number[chosen]]))
            there, bound = bounds.all(0), bounds.sum(0)
            chosen, bound = chosen[there], bound[there]
            order = np.argsort(-bound, kind="stable")
            chosen, bound = chosen[order], bound[order]
            spots, least = np.empty((len(mine), 0), np.int64), 0.0
            for some in (slice(0, AT_FIRST), slice(AT_FIRST, None)):  # the best cells, and then those whose bound reaches the k-th score
                if len(more := chosen[some][bound[some] >= least - SURE]):
                    spots = np.hstack((spots, meet(more, others)))
                    like = value[spots].sum(0)
                    least = np.partition(like, -k)[-k] if len(like) >= k else 0.0
            if not spots.size:
                continue
            spots = spots[:, like >= least - SURE]
            found, tallies = at[spots[0]], [x[spots].sum(0) for x in often]
            score = np.round(sum(FIELD_WEIGHTS[w] * t for w, t in zip(weights, tallies, strict=True)) / (1 + np.log(1.0 + length[found])), DIGITS)
            near = np.lexsort((rank[which[found]], -score))[:k]
            out.append((np.full(len(near), i), which[found[near]], length[found[near]], *[t[near] for t in tallies]))
        i, row, n, *tallies = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.empty(0, np.int64)] * (3 + len(weights))
        made = {"q": questions["q"].combine_chunks().take(pa.array(i)), "id": ids.take(pa.array(row)), "n": pa.array(n)}
        return pa.table(made | {f"t_{w}": pa.array(t) for w, t in zip(weights, tallies, strict=True)})

    return best


def search_many(spark: SparkSession, path: str, questions: DataFrame, k: int = 15, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, rank, id, score): for every question the k best of the chunks that hold all its words, as `search` scores them.

    Cells are dealt into groups and the sets of words asked into blocks. A task meets a block with the postings of a group: in
    the list of a set's rarest word it looks the others up, and it keeps k chunks of a set. So the postings of the words asked
    are shuffled once for each block, however many questions there are; what grows with questions times chunks are k narrow
    rows for each set and group.
    Rows with one id, which may be null, and the same words are one question; with other words they are others. Questions
    without words have no rows."""
    version = current(spark, path)
    asked = questions.select(F.col(qid).alias("qid"), F.array_sort(F.array_distinct(T.words(F.col(text)))).alias("ws")).filter("size(ws) > 0").distinct()
    postings = version._table("postings")
    if postings is None:
        kind = _nothing(spark, version).schema["id"].dataType.simpleString()
        return asked.select("qid", F.lit(1).alias("rank"), F.lit(None).cast(kind).alias("id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    asked = once(asked)
    sets = once(asked.select("ws").distinct().withColumn("q", F.monotonically_increasing_id()))
    wanted = once(sets.select(F.explode("ws").alias("tok")).distinct())
    if wanted.count() <= WORDS_SENT:  # else the postings are shuffled by their words
        wanted = F.broadcast(wanted)
    weights, chunks = version.weights, version.live()
    n_sets = max(1, -(-sets.count() * k // ROWS_GIVEN))
    n_cells = max(1, -(-sum(s["docs"] + s["dead"] for s in version.segments) // (CELL * FIRST_MANY)))
    group = _hashed(F.col("cell"), n_cells).alias("g")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = postings.join(wanted, "tok", "left_semi").select(group, "cell", "tok", "ords", *[f"tf_{w}" for w in weights])
    of = F.collect_list(F.struct("ord", "id", _add([F.col(f"n_{w}") for w in weights]).alias("n")))
    cells = chunks.groupBy("cell").agg(of.alias("own"))  # a cell's chunks
    cells = cells.select(group, "cell", F.col("own.ord").alias("ords"), F.col("own.n").alias(f"tf_{weights[0]}"), F.col("own.id").alias("ids"))
    given = blocks.unionByName(cells, allowMissingColumns=True).select(each(n_sets).alias("b"), "*")
    block = _hashed(F.col("q"), n_sets).alias("b")
    sought = sets.select(block, "q", "ws").select("b", each(n_cells).alias("g"), "q", "ws")
    schema = StructType([StructField("q", LongType()), StructField("id", chunks.schema["id"].dataType), StructField("n", LongType()), *[StructField(f"t_{w}", LongType()) for w in weights]])
    dealt = lambda rows: rows.repartition(2 * n_sets * n_cells, "b", "g").groupBy("b", "g")
    found = dealt(sought).cogroup(dealt(given)).applyInArrow(_answers(weights, k, to_arrow_schema(schema).empty_table()), schema)
    score = _add([F.lit(FIELD_WEIGHTS[w]) * F.col(f"t_{w}") for w in weights]) / (1 + F.log(1.0 + F.col("n")))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    found = found.select("q", "id", F.round(score, DIGITS).alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.join(sets, "q").join(asked, "ws").select("qid", "rank", "id", "score")


def scan_many(chunks: DataFrame, fields: dict[str, tuple[Column, str]], questions: DataFrame, k: int = 15, qid: str = "qid", text: str = "text", id_col: str = "id") -> DataFrame:
    """As `search_many`, over chunks that no index holds: one pass over the texts writes an index of the words asked, so that
    others are neither sorted nor written. Beyond `WORDS_SENT` words it writes one of all."""
    spark = chunks.sparkSession
    asked = questions.select(F.explode(T.words(F.col(text))).alias("tok")).distinct()
    wanted = [r["tok"] for r in asked.limit(WORDS_SENT + 1).collect()]
    path = shared_folder(spark, "asked")
    change(spark, path, chunks, fields, id_col=id_col, only=sorted(wanted) if len(wanted) <= WORDS_SENT else None)
    return search_many(spark, path, questions, k, qid, text)
