"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

quality       documents that the quality classifier rejects go
near_copies   one document of each group of near copies stays
benchmark     documents that hold a benchmark item, or an edited copy of one, go
secrets       secrets are masked in the texts
mix           sources are brought to their target weights
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, mixing, ngram_jaccard, quality, secret_scans
from quarry.llm._common import crc_of, fresh, shared_folder, table
from quarry.llm.queries import labelled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of predicted quality 1; learnt from labelled rows with crc32(doc_id) mod 3 other than 1."""
    learnt_from = F.coalesce(crc_of(F.col("doc_id")) % 3 != 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(learnt_from)
    model = quality.train(labelled(docs.select("doc_id", "text").filter(learnt_from), labels, "quality"))
    (score,) = fresh(docs, "score")
    return quality.score(docs, model).filter(F.col(score) >= 0.5).drop(score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more in five-word shingles."""
    return ngram_jaccard.unique(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; n_chars follows the text."""
    model = secret_scans.train(secret_scans.samples(docs))
    base, spans = fresh(docs, "base", "spans")
    found = secret_scans.scan(docs, model)
    masked = secret_scans.mask(F.col("text"), F.col(spans))
    changed = found.withColumn("text", masked)
    if "n_chars" in docs.columns:
        n = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return changed.drop(base, spans)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's size and target, and the words taken."""
    (taken,) = fresh(docs, "taken")
    return mixing.mix(docs, keep=True).filter(F.col(taken) > 0)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("secrets", secrets),
    ("mix", mix),
]

#: The stages learn models and hash, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each read from what the one before has written in the shared folder."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
