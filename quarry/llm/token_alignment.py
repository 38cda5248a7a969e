"""Alignment of two tokenizers over the same texts, by a sweep over the ends of their tokens.

Every text is encoded by both tokenizers. A token's end is its byte offset in space+text; the end events of both sides are
rows of packed ids, in blocks of at most `BLOCK` tokens that begin at a known offset. They are dealt to tasks by
document, sorted by document and offset, and streamed through a machine that holds two short queues. Where both sides
have an end, the tokens before it are whole groups and leave the machine. Between two neighbouring ends of either side
lies exactly one pair of overlapping tokens, so the links are the ends of the union, each with the token of either side
that stands over it.

Counts of linked id pairs over the corpus are added up in tasks before they are shuffled. They go back to the documents'
links as one table sent to the tasks if it has at most `SENT` pairs; beyond that, links and the counts of the pairs that
stand in a task's links meet by that task's number, the counts first.

Scale: ids cross the network once, two bytes each; texts never do. A task's state is the open group and the blocks
around it, not the document. Groups that never close (a text whose tokens end nowhere together) are kept until they do.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from ._common import cut, hold_batches, slices
from .token_counts import LONG_BLANK, PATTERN

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Tokens of one block of events.
BLOCK = 4096
#: Pairs whose counts are sent to all tasks (12 bytes each).
SENT = 4_000_000
#: Pairs that a task holds before it adds them up.
HELD = 2_000_000


def byte_signs() -> dict[str, int]:
    """The sign by which a byte-level vocabulary writes each byte: printable ones by themselves, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Coder:
    """Both tokenizers, and the bytes that their tokens stand for. Special tokens' strings are plain text."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(byte_level)
        self.slow.encode_special_tokens = True
        added = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        signs = byte_signs()
        own = {t: i for t, i in self.slow.get_vocab().items() if t not in added}
        self.a = [b""] * self.slow.get_vocab_size()
        for token, i in own.items():
            self.a[i] = bytes(signs[c] for c in token)
        # ids of this kind of vocabulary are in the order of merging
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.a[i]: i for i in own.values()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        place = range(self.pieces.get_piece_size())
        self.b = [
            bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in place)
        ]
        self.a_bytes, self.b_bytes = (np.array([len(t) for t in x], np.int64) for x in (self.a, self.b))
        self.a_kind, self.b_kind = (np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in (self.a, self.b))
        self.written = self._written()

    def _written(self) -> np.ndarray:
        """Decimal ids with what follows: A's by , or | (the last of a group), then B's by , or ;."""
        told = [f"{i}{after}".encode() for x, last in ((self.a, "|"), (self.b, ";")) for i in range(len(x)) for after in (",", last)]
        return np.array(told)

    def a_ids(self, text: str) -> np.ndarray:
        """The encoder's pattern fails on very long white space; such texts go to the slower one."""
        if LONG_BLANK.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.a_kind)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(self.a_kind)

    def encoded(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of space+text by A and of text by B; none where a text is empty or null or either side has other bytes."""
        out, none = [], (np.empty(0, self.a_kind), np.empty(0, self.b_kind))
        for text, ids in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1), strict=True):
            whole = f" {text}".encode() if text else b""
            if not text or b"".join(map(self.b.__getitem__, ids)) != whole:
                out.append(none)
                continue
            a = self.a_ids(f" {text}")
            out.append((a, np.array(ids, self.b_kind)) if int(self.a_bytes[a].sum()) == len(whole) else none)
        return out


@lru_cache(1)
def coder(byte_level: str, pieces: str) -> Coder:
    return Coder(byte_level, pieces)


def swept(c: Coder, a: np.ndarray, b: np.ndarray):
    """Whole groups of ids, as (places of links' A tokens, of their B tokens, ends of groups in A, in B, in bytes).

    The tokens of either side have the same bytes together. Ends of groups are numbers of tokens, exclusive."""
    a_ends, b_ends = np.cumsum(c.a_bytes[a]), np.cumsum(c.b_bytes[b])
    mark = np.zeros(int(a_ends[-1]) + 1, np.uint8)
    mark[a_ends] = 1
    mark[b_ends] += 2
    at = np.flatnonzero(mark)
    kind = mark[at]
    of_a, of_b = kind & 1, kind >> 1
    done_a, done_b = np.cumsum(of_a, dtype=np.int64), np.cumsum(of_b, dtype=np.int64)
    both = kind == 3
    return done_a - of_a, done_b - of_b, done_a[both], done_b[both], at[both]


def written(c: Coder, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The groups as a1,a2|b1;a3|b2,b3 with a ; after the last."""
    codes = np.empty(len(a) + len(b), np.int64)
    group = np.arange(len(a_ends))
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[a_ends - 1] = b_last[b_ends - 1] = 1
    a_group, b_group = (np.repeat(group, np.diff(e, prepend=0)) for e in (a_ends, b_ends))
    codes[np.arange(len(a)) + np.concatenate(([0], b_ends))[a_group]] = 2 * a.astype(np.int64) + a_last
    codes[np.arange(len(b)) + a_ends[b_group]] = 2 * (len(c.a) + b.astype(np.int64)) + b_last
    return c.written[codes].tobytes().translate(None, b"\0")


class Machine:
    """One document's sweep: takes blocks in the order of their offsets, gives whole groups as (A ids, B ids) that begin
    at byte `at`."""

    def __init__(self, c: Coder):
        self.c, self.at = c, 0
        self.queues = [[np.empty(0, c.a_kind)], [np.empty(0, c.b_kind)]]

    def put(self, side: int, offset: int, ids: np.ndarray):
        """Groups that are whole before a block that begins at `offset`, which is then queued."""
        some = self.groups(offset) if all(len(x[-1]) for x in self.queues) else None
        self.queues[side].append(ids)
        return some

    def groups(self, before: int | None = None):
        """(at, A ids, B ids) up to the last end that both sides have before an offset, or to the document's end; None
        without any."""
        a, b = (np.concatenate(x) for x in self.queues)
        if not len(a) or not len(b):
            return None
        cut_a, cut_b, begin, past = len(a), len(b), self.at, 0
        if before is not None:
            ends = [np.cumsum(n[x]) + begin for n, x in ((self.c.a_bytes, a), (self.c.b_bytes, b))]
            common = np.intersect1d(*(e[: np.searchsorted(e, before, "right")] for e in ends), assume_unique=True)
            if not len(common):
                self.queues = [[a], [b]]
                return None
            cut_a, cut_b = (int(np.searchsorted(e, common[-1], "right")) for e in ends)
            past = int(common[-1]) - begin
        self.queues = [[a[cut_a:]], [b[cut_b:]]]
        self.at = begin + past
        return begin, a[:cut_a], b[:cut_b]


def _sent(docs: DataFrame, *files: str) -> list[str]:
    for f in files:
        docs.sparkSession.sparkContext.addFile(f)
    return [os.path.basename(f) for f in files]


def events(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, id, at, side, ids): token end events in blocks; `key` numbers the rows of `docs`, `at` is the offset at which a
    block's first token begins, side 0 is A. A text without tokens is one empty block."""
    names = _sent(docs, byte_level, pieces)
    schema = StructType([StructField("key", LongType()), StructField("id", docs.schema[id_col].dataType)])
    schema = schema.add("at", LongType()).add("side", ByteType()).add("ids", BinaryType())

    def encode(batches):
        c = coder(*(SparkFiles.get(n) for n in names))
        for part in slices(batches):
            row, at, side, ids = [], [], [], []
            for i, pair in enumerate(c.encoded(part.column(2).to_pylist())):
                for s, (x, lengths) in enumerate(zip(pair, (c.a_bytes, c.b_bytes), strict=True)):
                    begins = np.cumsum(lengths[x]) - lengths[x]
                    for start in range(0, max(len(x), 1 - s), block):
                        row.append(i)
                        at.append(int(begins[start]) if len(x) else 0)
                        side.append(s)
                        ids.append(x[start : start + block].tobytes())
            own = pa.array(row, pa.int64())
            columns = [part.column(0).take(own), part.column(1).take(own), pa.array(at, pa.int64()), pa.array(side, pa.int8()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "id", "at", "side", "ids"])

    hold_batches(docs)
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, schema)


def in_order(given: DataFrame) -> DataFrame:
    """Events dealt by document, in the order of their offsets."""
    return given.repartition("key").sortWithinPartitions("key", "at", "side")


def _documents(c: Coder, batches):
    """For the rows of each document in turn: (id, iterator of (at, A ids, B ids))."""
    kinds, held = (c.a_kind, c.b_kind), {}

    def rows():
        for batch in batches:
            ids = batch.column(1)
            yield from ((k, ids[i], *rest) for i, (k, *rest) in enumerate(zip(*(batch.column(n).to_pylist() for n in (0, 2, 3, 4)), strict=True)))

    def one(first):
        machine, row = Machine(c), first
        while row is not None and row[0] == first[0]:
            if row[4]:
                some = machine.put(row[3], row[2], np.frombuffer(row[4], kinds[row[3]]))
                if some is not None:
                    yield some
            row = next(stream, None)
        held["next"] = row
        some = machine.groups()
        if some is not None:
            yield some

    stream = rows()
    first = next(stream, None)
    while first is not None:
        yield first[1], one(first)
        first = held["next"]


def groups(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per group: the id column, `start` and `end` (bytes of space+text), `a_ids`, `b_ids`. Texts without tokens
    have none; rows with one id are each swept by themselves."""
    names = _sent(docs, byte_level, pieces)

    def run(batches):
        c = coder(*(SparkFiles.get(n) for n in names))
        for own, parts in _documents(c, batches):
            for at, a, b in parts:
                _, _, a_ends, b_ends, ends = swept(c, a, b)
                ends = ends + at
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], e)).astype(np.int32)), pa.array(x.astype(np.int32))) for e, x in ((a_ends, a), (b_ends, b))]
                starts = np.concatenate(([at], ends[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(ends), own.type), pa.array(starts), pa.array(ends), *lists], ["id", "start", "end", "a_ids", "b_ids"])

    schema = StructType([StructField("id", docs.schema[id_col].dataType)]).add("start", LongType()).add("end", LongType()).add("a_ids", ArrayType(IntegerType())).add("b_ids", ArrayType(IntegerType()))
    found = in_order(events(docs, byte_level, pieces, id_col, text_col, block)).mapInArrow(run, schema)
    return found.withColumnRenamed("id", id_col if id_col.lower() not in ("start", "end", "a_ids", "b_ids") else f"_{id_col}")


SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _links(docs: DataFrame, names: list[str], ordered: DataFrame) -> DataFrame:
    """Rows of two kinds. Of documents (a row per run of whole groups): key, id, sums, groups_sha256 on the last, and the
    linked pairs with how often each is linked there, packed. Of a task (`part`): pair, n."""
    of_document = [("key", LongType()), ("id", docs.schema["id"].dataType), *[(n, LongType()) for n in SUMS]]
    fields = [*of_document, ("sha", StringType()), ("pairs", BinaryType()), ("often", BinaryType())]
    schema = StructType([StructField(*f) for f in (*fields, ("part", IntegerType()), ("pair", LongType()), ("n", LongType()))])
    arrow = {"sha": pa.string(), "pairs": pa.binary(), "often": pa.binary()}

    def run(batches):
        c = coder(*(SparkFiles.get(n) for n in names))
        number = TaskContext.get().partitionId()
        many, sums, room = [], [], HELD
        columns = [[] for _ in fields]

        def batch(values, own_type, pair=None, n=None):
            count = len(values[0]) if pair is None else len(pair)
            kinds = [own_type if f == "id" else arrow.get(f, pa.int64()) for f, _ in fields]
            arrays = [pa.array(v, k) if pair is None else pa.nulls(count, k) for v, k in zip(values, kinds, strict=True)]
            arrays += [pa.array(np.full(count, number, np.int32)), pa.nulls(count, pa.int64()) if pair is None else pa.array(pair), pa.nulls(count, pa.int64()) if n is None else pa.array(n)]
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        def added():
            """The pairs of the task so far, added up."""
            pairs, back = np.unique(np.concatenate(many), return_inverse=True)
            total = np.bincount(back, np.concatenate(sums)).astype(np.int64) if len(pairs) else np.empty(0, np.int64)
            return pairs.astype(np.int64), total

        own_type, key = pa.int64(), -1
        for own, parts in _documents(c, batches):
            own_type, key = own.type, key + 1
            digest, first, row = hashlib.sha256(), True, None
            for _, a, b in parts:
                if row is not None:
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                of_a, of_b, a_ends, b_ends, _ = swept(c, a, b)
                digest.update((b"" if first else b";") + written(c, a, b, a_ends, b_ends)[:-1])
                first = False
                pair, often = np.unique(a[of_a].astype(np.int64) * len(c.b) + b[of_b], return_counts=True)
                many.append(pair)
                sums.append(often)
                room -= len(pair)
                small = pair.astype(np.uint32 if len(c.a) * len(c.b) <= 1 << 32 else np.int64)
                row = [key, own.as_py(), len(a), len(b), len(a_ends), len(of_a), None, small.tobytes(), often.astype(np.uint32).tobytes()]
            row = row or [key, own.as_py(), 0, 0, 0, 0, None, b"", b""]
            row[6] = "" if first else digest.hexdigest()
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            if len(columns[0]) >= 256:
                yield batch(columns, own_type)
                columns = [[] for _ in fields]
            if room <= 0:
                pair, n = added()
                room = HELD - len(pair)
                if room < HELD // 2:  # still many after they were added up: they leave
                    yield batch(columns, own_type, pair, n)
                    many, sums, room = [], [], HELD
                else:
                    many, sums = [pair], [n]
        if columns[0]:
            yield batch(columns, own_type)
        if many:
            yield batch(columns, own_type, *added())

    return ordered.mapInArrow(run, schema)


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best) from (pair, n) of tasks: how often each pair is linked, and whether no pair of its B id is oftener."""
    total = rows.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair") % b_size)
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _scores(pairs: bytes, often: bytes, kind, known: np.ndarray, n: np.ndarray, best: np.ndarray) -> tuple[int, int]:
    at = np.searchsorted(known, np.frombuffer(pairs, kind))
    times = np.frombuffer(often, np.uint32).astype(np.int64)
    return int(times[best[at]].sum()), int((times * n[at]).sum())


def summary(
    docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sent: int = SENT
) -> DataFrame:
    """Per row of `docs`: the id column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (a byte-level vocabulary) encodes space+text, B (pieces, which add the space) text, both without special tokens. A
    group ends where tokens of both end; a link is a pair of tokens whose bytes overlap. A pair of ids counts as often
    as it is linked in the corpus; n_best is the number of links whose pair's count is the highest of its B id, ties
    included, count_sum the sum of the counts over the links. groups_sha256 is that of `a1,a2|b1;a3|b2,b3`.

    Null and empty texts, and those whose tokens' bytes differ from space+text on either side, have no tokens: zeros and
    an empty groups_sha256. Rows with one id are as many documents; a null id is kept. Other columns are ignored; an empty
    table gives no rows.
    """
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = _sent(docs, byte_level, pieces)
    c = coder(byte_level, pieces)
    size, kind = len(c.b), np.uint32 if len(c.a) * len(c.b) <= 1 << 32 else np.int64
    linked = cut(_links(given, names, in_order(events(given, byte_level, pieces, "id", "text", block))))
    of_tasks = linked.filter("pair is not null").select("part", "pair", "n")
    counts = cut(pair_counts(of_tasks, size))
    rows = linked.filter("key is not null").select("part", "key", "id", *SUMS, "sha", "pairs", "often")
    out = StructType([f for f in rows.schema.fields if f.name not in ("pairs", "often")]).add("n_best", LongType()).add("count_sum", LongType())

    def scored(batch: pa.RecordBatch, known, n, best) -> pa.RecordBatch:
        found = [_scores(p, o, kind, known, n, best) for p, o in zip(batch.column("pairs").to_pylist(), batch.column("often").to_pylist(), strict=True)]
        kept = [batch.column(f) for f in out.names[:-2]]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))], out.names)

    if counts.count() <= sent:
        table = counts.toArrow()
        known = np.asarray(table["pair"], np.int64)
        order = np.argsort(known)
        known, n, best = known[order].astype(kind), np.asarray(table["n"], np.int64)[order], np.asarray(table["best"])[order]

        def run(batches):
            for batch in batches:
                yield scored(batch, known, n, best)

        scores = rows.mapInArrow(run, out)
    else:
        own = of_tasks.select("part", "pair").distinct().join(counts, "pair").select("part", "pair", "n", "best")
        both = rows.unionByName(own, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", F.col("pair").asc_nulls_last())

        def run(batches):
            part, lists = None, None
            for batch in batches:
                # a batch may hold the end of one task's rows and the beginning of another's
                numbers = np.asarray(batch.column("part"))
                for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(numbers)) + 1):
                    rows_ = batch.slice(int(piece[0]), len(piece))
                    if numbers[piece[0]] != part:
                        part, lists, table = int(numbers[piece[0]]), [], None
                    is_count = np.asarray(rows_.column("pair").is_valid())
                    split = int(is_count.sum())
                    if split:
                        lists.append([np.asarray(rows_.column(x).slice(0, split)) for x in ("pair", "n", "best")])
                    if split < len(piece):
                        if table is None:
                            known, n, best = (np.concatenate(x) for x in zip(*lists, strict=True)) if lists else (np.empty(0), np.empty(0, np.int64), np.empty(0, bool))
                            table = (known.astype(kind), n.astype(np.int64), best.astype(bool))
                        yield scored(rows_.slice(split), *table)

        scores = both.mapInArrow(run, out)
    total = [F.sum(n).alias(n) for n in (*SUMS, "n_best", "count_sum")]
    found = scores.groupBy("part", "key").agg(F.first("id", ignorenulls=True).alias("id"), *total, F.max("sha").alias("groups_sha256"))
    name = id_col if id_col.lower() not in (*SUMS, "n_best", "count_sum", "groups_sha256") else f"_{id_col}"
    return found.select(F.col("id").alias(name), *SUMS, "n_best", "count_sum", "groups_sha256")
