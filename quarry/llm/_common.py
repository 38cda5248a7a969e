"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names near `bases` that clash with none of `df`, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as the session names it. Where none is named, one machine that is all there
    is (tests) makes its own; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once, written as a table in the shared folder and read from there; its lineage ends there.

    A table has its true size, by which Spark chooses joins. A checkpoint keeps the size that was estimated for its
    plan, which a join multiplies: over some rounds of joins that becomes a number of millions of digits."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(column):
    """crc32 of an id written as text, the fold key of the held-out splits."""
    return F.crc32(column.cast("string").cast("binary"))


#: Rows of one Arrow batch that carries whole texts; a batch of long ones must fit beside others in a task.
ARROW_ROWS = 1000


def hold_batches(df: DataFrame) -> None:
    """Let the session's Arrow batches have at most ARROW_ROWS rows."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def with_text(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, int, bool]:
    """The kept columns and the text for a Python pass: (rows, place of the text, whether it is one more column).

    A text that is kept anyhow is sent once."""
    hold_batches(docs)
    if text_col in kept:
        return docs.select(*kept), kept.index(text_col), False
    (name,) = fresh(docs, "text_")
    return docs.select(*kept, F.col(text_col).cast("string").alias(name)), len(kept), True


def slices(batches, rows: int = 256):
    """Arrow batches cut into slices of at most `rows` rows, so that what a slice needs stays small; memory that isn't
    used goes back at the end."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    pa.default_memory_pool().release_unused()


def coded_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between white space, as (starts, vocabulary, codes).

    The words of text i are vocabulary[codes[starts[i]:starts[i + 1]]]. A null text has none. Texts are trimmed before
    they are split: the split reads past the end of a last text that ends in white space, and finds words there.
    """
    texts = pc.utf8_trim_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts) if lower else texts)
    words = split.flatten()
    counts = np.asarray(pc.list_value_length(split), dtype=np.int64)
    full = np.asarray(pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False), dtype=bool)
    if not full.all():
        words = words.filter(pa.array(full))
        owner = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(owner, minlength=len(counts))
    starts = np.concatenate(([0], np.cumsum(counts)))
    coded = words.dictionary_encode()
    return starts, coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def hashes_of(strings: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in strings.to_pylist()), np.uint64, len(strings))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words as 64-bit hashes: those of text i are hashes[starts[i]:starts[i + 1]]."""
    starts, vocabulary, codes = coded_words(texts)
    return starts, hashes_of(vocabulary)[codes]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (Stafford's variant 13)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(starts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words; a shorter, non-empty text has the one run of all its words.

    Returns (starts, hashes) as `word_hashes` does, with one entry per position (repeats stay).
    """
    counts = np.diff(starts)
    runs = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    out_starts = np.concatenate(([0], np.cumsum(runs)))
    first = np.arange(out_starts[-1]) - np.repeat(out_starts[:-1] - starts[:-1], runs)
    last = np.repeat(starts[1:], runs)
    h = np.zeros(len(first), np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    for k in range(n):
        at = first + k
        word = np.where(at < last, padded[at], np.uint64(0x9E3779B97F4A7C15))
        h = mixed(h * np.uint64(0x100000001B3) + word)
    return out_starts, h
