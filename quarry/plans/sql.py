"""The searches as calls of SQL table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.sources import functions
from quarry.sources.store import read

from . import retrieval as plans


def _query(spark: SparkSession, d: str) -> str:
    """The functions over documents (sources as symbols, languages as paths) and the vector that is searched for."""
    docs = plans._docs(spark, d).select("id", F.col("lang").alias("path"), F.lit(None).cast("string").alias("kind"), F.col("source").alias("symbol"), F.col("text").alias("content"))
    functions.register(spark, docs.join(plans._vectors(spark, d).drop("label"), "id", "full_outer"))
    first = plans._first_vector(spark, d)
    return "CAST(NULL AS ARRAY<DOUBLE>)" if first is None else functions.vector(first)


def _parts(spark: SparkSession, d: str) -> None:
    columns = {"path": F.col("p_name"), "kind": F.col("p_type"), "symbol": F.col("p_name"), "content": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<double>")}
    functions.register(spark, read(spark, d, "part").select(F.col("p_partkey").alias("id"), *[c.alias(n) for n, c in columns.items()]))


def sql_match_chunks(spark, d):
    return spark.sql(f"SELECT * FROM match_chunks({_query(spark, d)}, 15, 0.2D)")


def sql_hybrid_chunks(spark, d):
    return spark.sql(f"SELECT * FROM hybrid_chunks({_query(spark, d)}, '{plans.QUERY}', 15, 0.7D, 0.3D)")


def sql_fused_chunks(spark, d):
    return spark.sql(f"SELECT * FROM fused_chunks({_query(spark, d)}, '{plans.QUERY}', 60, 15, 50, 50)")


def sql_like_symbols(spark, d):
    _parts(spark, d)
    return spark.sql("SELECT id, symbol AS p_name, similarity FROM like_symbols('blue widgt', NULL, 20)")


def sql_like_files(spark, d):
    _parts(spark, d)
    return spark.sql("SELECT path AS p_name, chunk_count, similarity FROM like_files('red ring', 20)")


def sql_cut_files(spark, d):
    """Lines and lengths of the chunks of documents that a lateral join cuts, by document."""
    _parts(spark, d)
    read(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("texts")
    return spark.sql("SELECT doc_id, count(*) AS chunks, max(end_line) AS last_line FROM texts, LATERAL cut_file('a.txt', text) f GROUP BY doc_id")


QUERIES = [sql_match_chunks, sql_hybrid_chunks, sql_fused_chunks, sql_like_symbols, sql_like_files, sql_cut_files]
SQL = {
    "sql_match_chunks": plans.SQL["knn_threshold"],
    "sql_hybrid_chunks": plans.SQL["hybrid_weighted"],
    "sql_fused_chunks": plans.SQL["hybrid_rrf"],
    "sql_like_symbols": plans.SQL["trigram_symbol"],
    "sql_like_files": plans.SQL["trigram_file"],
}
