"""Building an index: files to chunks with hashes, vectors and descriptions; whole, or for what has changed.

Vectors and descriptions come from providers, plain functions from a list of texts to a list of results that run inside
tasks, batch by batch. The defaults need no network: hashed words for vectors, no description.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from quarry.functions import paths as P
from quarry.functions import text as T
from quarry.operators import chunking, context, corpus, lexical
from quarry.sources.store import known_folder

DIMENSIONS, EMBED_BATCH, DESCRIBE_BATCH, TRIES = 1024, 128, 15, 5
#: Seconds for which a provider's result is kept.
REMEMBERED = 300


def hashed_words(texts: list[str]) -> list[list[float]]:
    """Offline stand-in for an embedding model: signed counts of hashed words, of length 1."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = zlib.crc32(word.encode())
            out[i, h % DIMENSIONS] += 1 if h & (1 << 20) else -1
        out[i] /= max(float(np.sqrt(out[i] @ out[i])), 1e-9)
    return out.tolist()


def undescribed(texts: list[str]) -> list[str | None]:
    """Offline stand-in for a model that describes chunks: no description."""
    return [None] * len(texts)


class Refused(Exception):
    """A provider's answer that another try can't change."""


class Throttled(Exception):
    """A provider's answer that asks to wait."""


def tried(provider: Callable, texts: list[str], tries: int = TRIES, second: float = 1.0) -> list:
    """A provider's results: after a throttled call wait 2, 4, 8 ... seconds, after another failure 1, 2, 3 ..."""
    for n in range(tries):
        try:
            return provider(texts)
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001
            if n == tries - 1:
                raise
            time.sleep(second * (2 * 2**n if isinstance(e, Throttled) else n + 1))
    return []


def embedded(chunks: DataFrame, text: str, provider: Callable = hashed_words, dimensions: int = DIMENSIONS) -> DataFrame:
    """Chunks with `embedding`; blank and null texts have a zero vector and are not sent to the provider."""

    names, schema = [*chunks.columns, "embedding"], StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, EMBED_BATCH):  # so many vectors are held at once
                part = batch.slice(a, EMBED_BATCH)
                texts = part.column(part.num_columns - 1).to_pylist()
                full, out = [i for i, t in enumerate(texts) if t and t.strip()], [[0.0] * dimensions for _ in texts]
                for i, v in zip(full, tried(provider, [texts[i] for i in full]) if full else [], strict=True):
                    out[i] = v
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.list_(pa.float32()))], names)

    return chunks.withColumn("_text", F.col(text)).mapInArrow(run, schema)


def remembered(
    chunks: DataFrame, text: str, path: str, now: str, provider: Callable = hashed_words, dimensions: int = DIMENSIONS, seconds: int = REMEMBERED
) -> DataFrame:
    """Chunks with `embedding`, as `embedded` gives them. The results of a provider are kept in a table by the hash of the text
    for `seconds`; it is called once for each distinct text that the table doesn't have, at the time `now`."""
    spark, at = chunks.sparkSession, F.lit(now).cast("timestamp")
    schema = "hash string, embedding array<float>, at timestamp"
    if not known_folder(spark, path):
        spark.createDataFrame([], schema).write.parquet(path)

    def held() -> DataFrame:
        rows = spark.read.schema(schema).parquet(path).filter((F.col("at") <= at) & (F.col("at") > at - F.make_interval(secs=F.lit(seconds))))
        return rows.groupBy("hash").agg(F.max_by("embedding", "at").alias("embedding"))

    hashed = chunks.withColumn("_hash", T.content_hash(F.coalesce(F.col(text), F.lit(""))))
    asked = hashed.select("_hash", text).dropDuplicates(["_hash"]).join(held().withColumnRenamed("hash", "_hash"), "_hash", "left_anti")
    new = embedded(asked, text, provider, dimensions).select(F.col("_hash").alias("hash"), "embedding", at.alias("at"))
    new.write.mode("append").parquet(path)
    return hashed.join(held(), F.col("_hash") == F.col("hash")).drop("_hash", "hash")


def described(chunks: DataFrame, text: str, provider: Callable = undescribed) -> DataFrame:
    """Chunks with `context`; where the provider fails or gives too few, it is null."""

    names, schema = [*chunks.columns, "context"], StructType([*chunks.schema.fields, StructField("context", StringType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1).to_pylist(), []
            for a in range(0, len(texts), DESCRIBE_BATCH):
                some = texts[a : a + DESCRIBE_BATCH]
                try:
                    said = list(tried(provider, some, 3))[: len(some)]
                except Exception:  # noqa: BLE001 - a chunk without a description is still a chunk
                    said = []
                out += said + [None] * (len(some) - len(said))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names)

    return chunks.withColumn("_text", F.col(text)).mapInArrow(run, schema)


def build(files: DataFrame, rules: list[str] = (), embed: Callable = hashed_words, describe: Callable = undescribed, dimensions: int = DIMENSIONS) -> DataFrame:
    """The index of files (path, content): chunks with id, hash of their file, tokens, context and embedding."""
    kept = files.filter(P.is_included(F.col("path"), list(rules)))
    chunks = chunking.chunk_files(kept).join(kept.select("path", T.content_hash(F.col("content")).alias("file_hash")), "path")
    chunks = chunks.withColumns({"id": chunking.index_key(F.concat_ws(":", "path", "start_line"), F.col("content")), "tokens": T.estimate_tokens(F.col("content"))})
    told = described(chunks, "content", describe).withColumn("_whole", context.enriched(F.col("context"), F.col("content")))
    return embedded(told, "_whole", embed, dimensions).drop("_whole")


def refreshed(index: DataFrame, files: DataFrame, **how) -> DataFrame:
    """The index after files changed: only added and modified files are chunked and embedded again."""
    before = index.select("path", F.col("file_hash").alias("sha")).distinct()
    now = files.filter(P.is_included(F.col("path"), list(how.get("rules", ())))).select("path", T.content_hash(F.col("content")).alias("sha"))
    changes = corpus.snapshot_diff(before, now)
    new = build(files.join(changes.filter("change <> 'deleted'").select("path"), "path", "left_semi"), **how)
    return index.join(changes.select("path"), "path", "left_anti").unionByName(new)


#: What a stored index keeps of a chunk beside its words.
KEPT = ["path", "start_line", "end_line", "language", "chunk_type", "symbol", "content", "file_hash", "tokens", "context", "embedding"]


def fields() -> dict:
    """The fields of a chunk that are searched, with their weights: symbol A, name of the file and type B, content C,
    dependencies D."""
    return {
        "symbol": (F.col("symbol"), "A"), "file": (T.basename(F.col("path")), "B"), "type": (F.col("chunk_type"), "B"),
        "content": (F.col("content"), "C"), "dependencies": (F.array_join("dependencies", " "), "D"),
    }


def stored(files: DataFrame, path: str, **how) -> lexical.Version:
    """Build the index of files (path, content) and write it to a folder, for search by words and by vectors (`live`)."""
    return lexical.write(_incoming(build(files, **how), path), fields(), path, keep=KEPT)


def _incoming(chunks: DataFrame, path: str) -> DataFrame:
    """Chunks, written once, since providers are called for them."""
    target = f"{path}/incoming"
    chunks.write.mode("overwrite").parquet(target)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(target)


def refreshed_store(files: DataFrame, path: str, **how) -> lexical.Version:
    """The stored index after files changed: chunks of changed and deleted files go, added and changed files are cut, described
    and embedded; segments that have become many are merged."""
    spark, live = files.sparkSession, lexical.current(files.sparkSession, path).live()
    if live is None:
        return stored(files, path, **how)
    before = live.select("path", F.col("file_hash").alias("sha")).distinct()
    now = files.filter(P.is_included(F.col("path"), list(how.get("rules", ())))).select("path", T.content_hash(F.col("content")).alias("sha"))
    changes = corpus.snapshot_diff(before, now)
    new = _incoming(build(files.join(changes.filter("change <> 'deleted'").select("path"), "path", "left_semi"), **how), path)
    gone = live.join(changes.filter("change <> 'added'").select("path"), "path", "left_semi").select("id")
    lexical.change(spark, path, new, fields(), gone, keep=KEPT)
    return lexical.merge(spark, path)
