"""Structured Streaming: an index kept up to date from files as they arrive, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.incremental import ContentState


def keep_up(stream: DataFrame, state: ContentState, keys: list[str], order: str, checkpoint: str, name: str):
    """Feed micro-batches of (keys, content_hash, order) into a ContentState; each commits once.

    A batch is named by its id, so a batch that is played again after a failure is not processed a second time. Of
    several rows of a key the last in order counts, in whichever batch it comes. Gives the running query; use trigger(availableNow) via
    the returned writer's defaults: it ends when the present files are read.
    """

    state.order_by(stream.schema[order].dataType)

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy(*keys).agg(F.max(F.struct(order, "content_hash")).alias("l")).select(*keys, F.col("l.content_hash").alias("content_hash"), F.col(f"l.{order}").alias("order"))
        state.process(last, f"{name}-{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(stream: DataFrame, time: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Counts in windows of a fixed length; rows later than `late` behind the newest are dropped by the watermark."""
    w = F.window(time, length)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("began"), F.col("window.end").alias("ended"), *keys, "n"
    )


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts in sessions that end after a gap."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(
        F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), *keys, "n"
    )
