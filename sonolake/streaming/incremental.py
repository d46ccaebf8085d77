"""Incremental scans as a file stream: each new file is handled once, also after a restart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import scan

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, per_trigger: int = 50) -> DataFrame:
    """A stream of path, length, filename, ext and kind of audio files."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return scan.classify(files.select("path", "length", "modificationTime"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Handles what is there in batches, appends each to Parquet below out/batch=<n> (a repeated batch replaces itself), and stops."""

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_time(rows: DataFrame, column: str = "ts") -> DataFrame:
    """Timestamps without zone cannot carry a watermark."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def loudness_windows(events: DataFrame, size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Level and peak of each user's samples in tumbling windows, for batches or streams; later rows than `late` are dropped in streams."""
    timed = event_time(events).withWatermark("ts", late)
    each = timed.groupBy(F.window("ts", size), "user_id").agg(F.count("*").alias("n"), F.max("value").alias("peak"), (20 * F.log10(F.sqrt(F.avg(F.col("value") * F.col("value"))) + 1e-10)).alias("level"))
    return each.select(F.col("window.start").alias("start"), "user_id", "n", "peak", "level")
