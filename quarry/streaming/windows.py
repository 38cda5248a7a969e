"""Windows over usage events; each function takes a static or a streaming DataFrame."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def tumbling(events: DataFrame, every: str = "1 day", by: str = "event_type", late: str = LATE) -> DataFrame:
    """(start, by, events, value) of fixed windows; a stream drops what is later than `late`."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    out = watched.groupBy(F.window("ts", every).alias("w"), by).agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").alias("start"), by, "events", F.round("value", 4).alias("value"))


def sliding(events: DataFrame, length: str = "2 days", every: str = "1 day", by: str = "event_type", late: str = LATE) -> DataFrame:
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    out = watched.groupBy(F.window("ts", length, every).alias("w"), by).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("start"), by, "events")


def sessions(events: DataFrame, gap: str = "6 hours", by: str = "user_id", late: str = LATE) -> DataFrame:
    """(by, start, events): runs of a key's events less than `gap` apart."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    out = watched.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("events"))
    return out.select(by, F.col("w.start").alias("start"), "events")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="streams-")
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def once(rows: DataFrame, name: str = "rows") -> DataFrame:
    """Rows that several parts of a query read, computed once and read from the shared folder."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_to_table(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """What a stream has put out after all input that is there now, kept as Parquet in the shared folder.

    Each micro-batch replaces (complete) or adds to (append, update) the table; a batch that is run again after a
    failure overwrites its own files, so that nothing counts twice."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, name)

    def put(batch: DataFrame, number: int) -> None:
        part = "all" if mode == "complete" else f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{out}/table/{part}")

    query = (
        stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table/*")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as a stream from a Parquet file, or from the files of a folder.

    The path is given as a pattern that only it fulfils, since the source takes a single file by pattern alone."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))
