"""Streams over event folders: windows with late data, sessions, and ingest that goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.normalize import normalize


def read(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windows(events: DataFrame, time: str, seconds: int, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Tumbling counts; events more than `late` behind are left out once their window is closed."""
    w = F.window(time, f"{seconds} seconds")
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def resume(lines: DataFrame, out: str, checkpoint: str) -> None:
    """Appends the flat events of new line files to `out` and stops; a later call goes on from the checkpoint, each file once.

    lines: a stream of archive_name, member_name, line_number, line, whole archives in a batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        normalize(batch).withColumn("epoch", F.lit(epoch)).write.partitionBy("epoch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(out)

    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
