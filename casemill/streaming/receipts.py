"""Receipts as a stream: terminal-state dedup, windowed counts, replay of a ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.runtime import shared_dir


def stream_table(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 4) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_receipts(stream: DataFrame, call: str, event_time: str, lateness: str = "30 days") -> DataFrame:
    """The first receipt of each call: a finished call is terminal, later ones are dropped as long as the watermark keeps
    the call in mind. State grows with the calls of one lateness, not with the log."""
    return stream.where(F.col(call).isNotNull()).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([call])


def windowed_counts(stream: DataFrame, event_time: str, width: str, by: list[str], lateness: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, by, n) over tumbling windows, or sliding ones with slide."""
    window = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, lateness).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def sessions(stream: DataFrame, event_time: str, gap: str, by: list[str], lateness: str = "1 hour") -> DataFrame:
    """(session_start, session_end, by, n) over sessions that end after a gap."""
    return stream.withWatermark(event_time, lateness).groupBy(F.session_window(event_time, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def replay(stream: DataFrame, mode: str = "append", output: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now, into Parquet, and returns the result as a table. In mode complete
    every batch writes the whole result anew, so that of the last one stays; nothing is kept in the driver. Checkpoints live in the shared folder, so a restarted driver goes on where it was."""
    spark = stream.sparkSession
    name = f"casemill_{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}-checkpoint").trigger(availableNow=True)
    path = output or f"{base}-out"
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
