"""New and changed files only: a file stream with a checkpoint, and keyed upserts of its batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def html_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """source_file, mtime and html of files as they come."""
    reader = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("html"))


def process_new(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs what is there through transform, once each, to Parquet under out; each batch has its own folder, so a repeated one replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))).where("__place = 1").drop("__place")


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old with new rows in place of those of the same keys."""
    return latest(new if old is None else old.unionByName(new), keys, order)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts by type and window (tumbling, or sliding by slide); rows later than late don't count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(events: DataFrame, *keys: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: events less than gap apart."""
    return events.withWatermark("ts", late).groupBy(*keys, F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
