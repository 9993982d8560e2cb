"""Queries that run streams to their end, with the shared folder for checkpoints and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import shared
from skein.operators import ingest
from skein.plans.registry import query
from skein.streaming import ingest as stream


def _run(spark: SparkSession, made: DataFrame) -> DataFrame:
    """Run a stream of windows to its end: what has been emitted in append mode."""
    base = shared.scratch(spark, "stream")
    writing = made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    writing.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{base}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.read(spark, f"{sf_dir}/events*.parquet")


#: A window is emitted when the watermark, ten minutes behind the latest event, has passed its end.
_CLOSED = "(select max(ts) - interval 10 minute from events)"


@query(f"""
with w as (select date_trunc('day', ts) as s, event_type, value from events)
select strftime(s, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 6) as total from w where s + interval 1 day <= {_CLOSED} group by all""")
def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a stream with a watermark."""
    w = _run(spark, stream.window_counts(_events(spark, sf_dir)))
    return w.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""
with w as (select to_timestamp(floor(epoch(ts) / 43200) * 43200)::timestamp - unnest([interval 0 hour, interval 12 hour]) as s, event_type, value from events)
select strftime(s, '%Y-%m-%d %H') as start, event_type, count(*) as n, round(sum(value), 6) as total from w where s + interval 1 day <= {_CLOSED} group by all""")
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day that start every twelve hours."""
    w = _run(spark, stream.window_counts(_events(spark, sf_dir), "1 day", "12 hours"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"""
with e as (select user_id, ts, coalesce(ts > lag(ts) over (partition by user_id order by ts) + interval 30 minute, true) as new from events),
g as (select user_id, ts, sum(new::integer) over (partition by user_id order by ts rows unbounded preceding) as g from e),
s as (select user_id, min(ts) as a, max(ts) + interval 30 minute as b, count(*) as n from g group by user_id, g)
select user_id, strftime(a, '%Y-%m-%d %H:%M:%S') as start, strftime(b, '%Y-%m-%d %H:%M:%S') as ended, n from s where b <= {_CLOSED}""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that end after 30 minutes without an event."""
    s = _run(spark, stream.session_counts(_events(spark, sf_dir)))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return s.select("user_id", text("start").alias("start"), text("end").alias("ended"), "n")


@query("select doc_id, 'add' as action from documents")
def stream_incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each twice in a batch, as a stream of changes against what was taken in before; a second run adds nothing."""
    base = shared.scratch(spark, "ingest")

    def sink(batch: DataFrame, _: int) -> None:
        new = batch.select(F.col("doc_id").alias("wiki_id"), F.col("lang").alias("last_updated"))
        new = ingest.first_rows(new.unionByName(new.withColumn("last_updated", F.lit("again"))))
        stored = spark.read.schema("wiki_id long, stored string, action string").parquet(f"{base}/taken")
        todo = ingest.changes(new, stored.select("wiki_id", "stored")).where("action <> 'skip'")
        todo.select("wiki_id", F.col("last_updated").alias("stored"), "action").write.mode("append").parquet(f"{base}/taken")

    spark.createDataFrame([], "wiki_id long, stored string, action string").write.parquet(f"{base}/taken")
    for run in ("a", "b"):  # two checkpoints, so the second run sees all files again
        stream.run_once(stream.read(spark, f"{sf_dir}/documents*.parquet"), sink, f"{base}/{run}")
    return spark.read.parquet(f"{base}/taken").select(F.col("wiki_id").alias("doc_id"), "action")
