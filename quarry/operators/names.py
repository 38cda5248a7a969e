"""A stored trigram index of names (symbols, paths), for search by similarity that splits no name again.

grams/bucket=b    a row per trigram and distinct name, in folders by a hash of the trigram, sorted by it and by the number of
                  trigrams that the name has
rows/bucket=b     the rows that bear each name, in folders by a hash of the name

The similarity of two texts is the share of the trigrams that both have. A name can only be as like as asked if it has enough
trigrams, and not too many (the length filter, a range of the sorted files), and shares enough of them (the count filter).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators.retrieval import DIGITS, top
from quarry.streaming.windows import once

LEAST = 0.3
#: Rows of a folder, and folders at most.
FOLDER_ROWS, FOLDERS = 2_000_000, 4096


def _hashed(of: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(n)).cast("int")


def write(rows: DataFrame, name: str, path: str, keep: list[str] = ()) -> None:
    """Index the rows that have a name; `keep`: their other columns that searches return or filter by."""
    spark = rows.sparkSession
    named = rows.select(F.col(name).alias("name"), *keep).filter("name is not null")
    about = named.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("name")), F.lit(0)).alias("chars")).first()
    folders = [max(1, min(FOLDERS, -(-n // FOLDER_ROWS))) for n in (about["chars"], about["n"])]
    distinct = named.select("name").distinct().withColumn("gs", T.trigrams(F.col("name")))
    grams = distinct.select(F.explode("gs").alias("gram"), F.size("gs").alias("size"), "name")
    # the rows of one trigram may be a large share of all: a file of a folder takes those of some names
    files = max(1, -(-about["chars"] // (folders[0] * FOLDER_ROWS)))
    put = grams.withColumn("bucket", _hashed(F.col("gram"), folders[0])).repartition(folders[0] * files, "bucket", _hashed(F.col("name"), files))
    put.sortWithinPartitions("bucket", "gram", "size").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    put = named.withColumn("bucket", _hashed(F.col("name"), folders[1])).repartition(folders[1], "bucket")
    put.sortWithinPartitions("bucket", "name").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in named.schema.fields)
    spark.createDataFrame([(*folders, schema)], "grams int, rows int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    about = spark.read.parquet(f"{path}/about").first().asDict()
    grams = spark.read.schema("gram string, size int, name string, bucket int").parquet(f"{path}/grams")
    return grams, spark.read.schema(f"{about['schema']}, bucket int").parquet(f"{path}/rows").drop("bucket"), about


def _similarity(shared: Column, left: Column, right: Column) -> Column:
    return F.round(shared.cast("double") / (left + right - shared).cast("double"), DIGITS)


def _shares(shared: Column, left: Column, right: Column, least: float) -> Column:
    """The count filter: as many shared trigrams as a similarity of `least` takes."""
    return shared >= F.ceil(F.lit(least / (1 + least)) * (left + right) - F.lit(1e-6))


def similar(spark: SparkSession, path: str, query: str, least: float = LEAST) -> DataFrame:
    """(name, similarity) of the distinct names that are like the query; reads its trigrams' lists, within the lengths that a
    like name can have."""
    grams, _, about = _tables(spark, path)
    wanted = spark.range(1).select(T.trigrams(F.lit(query)).alias("g")).select("g", F.transform("g", lambda g: _hashed(g, about["grams"])).alias("b")).first()
    n = len(wanted["g"])
    low, high = math.ceil(least * n - 1e-6), math.floor(n / least + 1e-6)
    held = grams.filter(F.col("bucket").isin(sorted(set(wanted["b"]))) & F.col("gram").isin(wanted["g"]) & F.col("size").between(low, high))
    counted = held.groupBy("name", "size").agg(F.count("*").alias("shared")).filter(_shares(F.col("shared"), F.col("size"), F.lit(n), least))
    return counted.select("name", _similarity(F.col("shared"), F.col("size"), F.lit(n)).alias("similarity")).filter(F.col("similarity") >= least)


def similar_many(spark: SparkSession, path: str, questions: DataFrame, least: float = LEAST, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, name, similarity) of the distinct names like each question's text.

    A like name has one of a question's rarest trigrams, all but as many as it may lack; only their lists are joined, and what
    they find within the lengths is compared."""
    grams, _, _ = _tables(spark, path)
    sizes = grams.groupBy("gram").agg(F.count("*").alias("df"))
    asked = questions.select(F.col(qid).alias("qid"), F.col(text).alias("text")).distinct().withColumn("gs", T.trigrams(F.col("text")))
    each = asked.select("qid", "text", F.size("gs").alias("n"), F.explode("gs").alias("gram")).join(sizes, "gram", "left")
    place = F.row_number().over(Window.partitionBy("qid", "text").orderBy(F.col("df").asc_nulls_first(), "gram"))
    needed = F.ceil(F.lit(least) * F.col("n") - F.lit(1e-6))
    probes = each.withColumn("place", place).filter(F.col("place") <= F.col("n") - needed + 1).filter("df is not null")
    fits = F.col("size").between(needed, F.floor(F.col("n") / F.lit(least) + F.lit(1e-6)))
    pairs = probes.join(grams.drop("bucket"), "gram").filter(fits).select("qid", "text", "name").distinct()
    compared = pairs.withColumn("similarity", F.round(T.trigram_similarity(T.trigrams(F.col("name")), T.trigrams(F.col("text"))), DIGITS))
    return compared.filter(F.col("similarity") >= least).select("qid", "name", "similarity")


def rows_like(spark: SparkSession, path: str, query: str, k: int = 20, where: Column | None = None, by: str = "id", least: float = LEAST) -> DataFrame:
    """The k rows of the most similar names that fulfil a condition, with `name` and `similarity`."""
    _, rows, _ = _tables(spark, path)
    found = (rows if where is None else rows.filter(where)).join(similar(spark, path, query, least), "name")
    return top(found, k, F.desc("similarity"), F.col(by))


def rows_like_many(spark: SparkSession, path: str, questions: DataFrame, k: int = 20, by: str = "id", least: float = LEAST, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, rank, name, similarity, other columns): as `rows_like`, for every question.

    Rows of one name are alike, so no question has more than the first k of each; only these meet the questions."""
    _, rows, _ = _tables(spark, path)
    like = once(similar_many(spark, path, questions, least, qid, text))
    first = F.row_number().over(Window.partitionBy("name").orderBy(by))
    few = rows.join(like.select("name").distinct(), "name", "left_semi").withColumn("first", first).filter(F.col("first") <= k).drop("first")
    found = few.join(like, "name")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("similarity"), by))).filter(F.col("rank") <= k)


def names_like(spark: SparkSession, path: str, query: str, k: int = 20, least: float = LEAST) -> DataFrame:
    """(name, chunk_count, similarity): the k most similar names with their numbers of rows."""
    _, rows, _ = _tables(spark, path)
    found = rows.join(similar(spark, path, query, least), "name").groupBy("name", "similarity").agg(F.count("*").alias("chunk_count"))
    return top(found.select("name", "chunk_count", "similarity"), k, F.desc("similarity"), F.col("name"))
