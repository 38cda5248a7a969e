"""Stages one by one on a table with odd rows, and the whole on the driver's."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from quarry.llm import decontamination, ngram_jaccard, secret_scans


def odd_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = [
        (None, None, None, None, None), (90_001, "", "en", "src0", 0), (90_002, None, None, None, None), (None, "a b c d e f", "en", None, 11),
        (90_003, "word " * 100_000, "en", "src1", 500_000), (90_004, "some words password=abcdef0123456789 and more of them", "en", "src2", 53),
    ]
    more = spark.createDataFrame(extra, docs.schema)
    return docs.unionByName(more).unionByName(docs.limit(3)).withColumns({"Score": F.lit("x"), "taken": F.lit(1), "keep": F.lit(None).cast("string"), "t": F.lit(2)})


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage(spark, small, name):
    docs, stage = odd_documents(spark, small), dict(C.STAGES)[name]
    out = stage(spark, docs, small)
    rows = out.count()
    assert 0 < rows <= docs.count()
    if name != C.STAGES[-1][0]:
        assert out.columns == docs.columns
    none = stage(spark, docs.filter("false"), small)
    assert none.count() == 0


def test_stages_take_effect(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    good = C.good(spark, docs, medium)
    kept = labels.join(good.select("doc_id"), "doc_id", "left_semi").groupBy("quality").count().collect()
    n = {r["quality"]: r["count"] for r in kept}
    assert n[1] >= 0.99 * labels.filter("quality = 1").count() and n.get(0, 0) <= 0.05 * labels.filter("quality = 0").count()
    links = ngram_jaccard.join(docs.select("doc_id", "text"))
    unique = {r["doc_id"] for r in C.near_copies(spark, docs, medium).select("doc_id").collect()}
    assert unique == {r["doc_id"] for r in links.filter("doc_id = class_id").collect()}
    bad = {r["doc_id"] for r in decontamination.leaks(docs, spark.read.parquet(f"{medium}/benchmark.parquet")).collect()}
    clean = {r["doc_id"] for r in C.benchmark(spark, docs, medium).select("doc_id").collect()}
    assert clean == {r["doc_id"] for r in docs.select("doc_id").collect()} - bad
    masked = C.secrets(spark, docs, medium)
    model = secret_scans.train(secret_scans.samples(docs))
    assert secret_scans.scan(masked, model).filter("size(base) > 0").count() == 0
    assert masked.filter("n_chars <> length(text)").count() == 0 and masked.count() == docs.count()


def test_run(spark, small):
    out = C.run(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert out.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
