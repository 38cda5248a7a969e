"""Tables of the index and of the accounts: reading, listing files, and the writes that keep them current.

Writes are whole-partition or whole-table rewrites through a staged directory, since Parquet has no row updates; each
is a DataFrame that a caller writes with `replace_partitions`.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def known_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at a path."""
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            raise
        return False
    return True


def list_files(spark: SparkSession, root: str, most: int | None = 5000) -> DataFrame:
    """(path, size) below a folder, in order of path; `most` is the listing's own limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = files.select(F.regexp_replace("path", "^(file|hdfs):/*", "/").alias("path"), F.col("length").alias("size"))
    return listed if most is None else listed.orderBy("path").limit(most)


def listed(spark: SparkSession, root: str, most: int = 5000) -> DataFrame:
    """(path, size, truncated): the first files below a folder, and whether there are more than `most`."""
    some = list_files(spark, root, most + 1)
    place = F.row_number().over(Window.orderBy("path"))  # of at most so many rows
    counted = some.withColumns({"_place": place, "truncated": F.count("*").over(Window.partitionBy()) > most})
    return counted.filter(F.col("_place") <= most).drop("_place")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, content) of text files below a folder, each decoded as UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(
        F.regexp_replace("path", "^(file|hdfs):/*", "/").alias("path"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("content")
    )


def structure(files: DataFrame) -> DataFrame:
    """One row about a listing: files, bytes, and the estimated lines."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn(
        "lines", F.ceil(F.col("bytes") / F.lit(40.0)).cast("long")
    )


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write rows in place of all that their partitions held; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def replaced(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """The table after all rows of the owners in `new` gave way to those in `new`."""
    owners = new.select(owner).distinct()
    return old.join(owners, owner, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], only_given: bool = False) -> DataFrame:
    """Rows of `new` in place of those with their keys, other rows as they were; `only_given` keeps old values where
    the new ones are null. Of several new rows with a key the last by `seq` (a column of `new` alone) holds."""
    if "seq" in new.columns and "seq" not in old.columns:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("seq")))
        new = new.withColumn("_last", last).filter("_last = 1").drop("_last", "seq")
    if not only_given:
        return old.join(new, keys, "left_anti").unionByName(new)
    others = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in others], F.lit(True).alias("_is_new"))
    joined = old.withColumn("_is_old", F.lit(True)).join(renamed, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in others])


def without(df: DataFrame, condition: Column) -> DataFrame:
    """The table after the rows that fulfil a condition are gone; rows for which it is null stay."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def deleted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """The table after the rows that fulfil a condition are gone, and how many those are."""
    return without(df, condition), df.filter(condition).count()


def exists(df: DataFrame, condition: Column) -> bool:
    """Whether a row fulfils a condition; the first that is found ends the search."""
    return not df.filter(condition).limit(1).isEmpty()


def updated(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def cascade_delete(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], table: str, gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables after rows of `table` with a key in `gone` went, and what hangs on them. `links`: (child, its column,
    parent, its column), parents before children."""
    out = dict(tables)
    lost = {table: tables[table].join(gone.select(key).distinct(), key, "left_semi")}
    out[table] = tables[table].join(gone.select(key).distinct(), key, "left_anti")
    for child, c_col, parent, p_col in links:
        if parent in lost:
            dead = lost[parent].select(F.col(p_col).alias(c_col)).distinct()
            lost[child] = tables[child].join(dead, c_col, "left_semi")
            out[child] = out[child].join(dead, c_col, "left_anti")
    return out


def merged_first(parts: list[DataFrame], key: str, order: Column) -> DataFrame:
    """All rows of the parts, one per key, from the first part that has it."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_part", order))
    return every.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "_part")
