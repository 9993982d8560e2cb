"""Streams: incremental ingest by ``foreachBatch``, and windowed counts with a watermark.

Late rows beyond ``WATERMARK`` are dropped; a window is emitted once, when the watermark passes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WATERMARK = "10 minutes"


def read(spark: SparkSession, path: str, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder (or glob), with the schema that they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def window_counts(events: DataFrame, width: str = "1 day", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """``(start, end, event_type, n, total)`` over tumbling or sliding windows of event time; works on streams and tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    """``(user_id, start, end, n)`` over sessions of a user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    out = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there in micro-batches, and stop; the checkpoint makes the next run go on from here."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_stream(articles: DataFrame, store, embed, metadata, checkpoint: str, mode: str = "differs") -> None:
    """Articles of a stream into a store: each micro-batch is one change-detecting ingest, so a replayed batch is a no-op."""
    from skein.operators.ingest import ingest

    run_once(articles, lambda batch, _: ingest(batch, store, embed, metadata, mode=mode), checkpoint)
