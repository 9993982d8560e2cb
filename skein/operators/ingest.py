"""Ingest state: change detection, merges, the progress table, run summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import log, shared
from skein.session import ValidationError

PROGRESS = "id string, article_id string, article_last_updated string, status string, batch_number int, processed_at timestamp, created_at timestamp, error_message string"
STATES = ("pending", "processing", "completed", "failed")


#: Earlier and present schemas of the progress table.
VERSIONS = {1: "id string, article_id string, article_last_updated string, status string, created_at timestamp", 2: PROGRESS}


def migrate(progress: DataFrame, version: int = max(VERSIONS)) -> DataFrame:
    """The progress table in the schema of a version, up or down."""
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version}")
    return conform(progress, VERSIONS[version])


def conform(rows: DataFrame, schema: str = PROGRESS) -> DataFrame:
    """``rows`` brought to a later (or earlier) schema: new columns are null, dropped ones go, types are cast."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return rows.select(*((F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in fields))


def changes(articles: DataFrame, stored: DataFrame, mode: str = "differs", force: bool = False) -> DataFrame:
    """``articles`` with ``action``: add, update or skip.

    ``stored`` has (wiki_id, stored).  Versions are texts: ``differs`` updates where they are
    unequal, ``newer`` where the article's is greater (no version in either: skip).  ``force``
    updates whatever is stored.
    """
    joined = articles.join(stored.select("wiki_id", F.col("stored").alias("_stored"), F.lit(True).alias("_known")), "wiki_id", "left")
    new = F.col("_known").isNull()
    changed = F.lit(True) if force else ~F.col("last_updated").eqNullSafe(F.col("_stored")) if mode == "differs" else F.coalesce((F.col("last_updated") > F.col("_stored")) & (F.col("last_updated") != ""), F.lit(False))
    return joined.withColumn("action", F.when(new, "add").when(changed, "update").otherwise("skip")).drop("_stored", "_known")


def merge(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``stored`` with the rows of ``new`` in the place of those with the same key: one anti join, no rewrite of the rest."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def upsert_progress(progress: DataFrame, new: DataFrame) -> DataFrame:
    """Progress rows with ``new`` (article_id, article_last_updated, status, batch_number) merged in; ids and creation stay."""
    n = new.select("article_id", *(F.col(c).alias(f"_{c}") for c in ("article_last_updated", "status", "batch_number")))
    both = progress.join(n, "article_id", "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c).alias(c)
    return both.select(
        F.coalesce("id", F.expr("uuid()")).alias("id"), "article_id", pick("article_last_updated"), pick("status"), pick("batch_number"),
        F.when(F.col("_status") == "completed", F.current_timestamp()).otherwise(F.col("processed_at")).alias("processed_at"),
        F.coalesce("created_at", F.current_timestamp()).alias("created_at"), F.when(F.col("_status").isNull(), F.col("error_message")).alias("error_message"),
    )


def move(progress: DataFrame, ids: DataFrame, status: str, error: str | None = None) -> DataFrame:
    """Progress with the rows of ``ids`` (article_id) in another state."""
    if status not in STATES:
        raise ValueError(f"unknown state {status}")
    hit = progress.join(ids.select("article_id", F.lit(True).alias("_hit")).distinct(), "article_id", "left")
    on = F.col("_hit").isNotNull()
    out = hit.withColumn("status", F.when(on, status).otherwise(F.col("status")))
    out = out.withColumn("error_message", F.when(on, F.lit(error)).otherwise(F.col("error_message")))
    if status == "completed":
        out = out.withColumn("processed_at", F.when(on, F.current_timestamp()).otherwise(F.col("processed_at")))
    return out.drop("_hit")


def roll_back(progress: DataFrame) -> DataFrame:
    """Rows in work go back to pending; count them before with ``in_work``."""
    return progress.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def in_work(progress: DataFrame) -> DataFrame:
    return progress.where(F.col("status") == "processing")


def completed(progress: DataFrame) -> DataFrame:
    return progress.where(F.col("status") == "completed")


def to_process(articles: DataFrame, progress: DataFrame) -> DataFrame:
    """Articles that are new, or whose completed version differs; only completed rows count."""
    return changes(articles, completed(progress).select(F.col("article_id").alias("wiki_id"), F.col("article_last_updated").alias("stored"))).where("action <> 'skip'")


def last_batch(progress: DataFrame) -> DataFrame:
    """One row: the largest completed batch number, 0 if none."""
    return completed(progress).agg(F.coalesce(F.max("batch_number"), F.lit(0)).alias("last_batch"))


def batches(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """``rows`` with ``batch``, numbered from 1, ``size`` rows to a batch in order of a unique column.

    Rows are range-sorted; a row's place is its place in its partition after the rows of the
    partitions before, so no single task sees all rows and only one count a partition is collected.
    The sorted rows are materialised, as a second sort may cut them at other places.
    """
    placed = shared.materialise(rows.orderBy(order).withColumn("_m", F.monotonically_increasing_id()))
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], before))
        before += r["count"]
    table = rows.sparkSession.createDataFrame(offsets, "_p long, _before long")
    out = placed.withColumn("_p", part).join(F.broadcast(table), "_p")
    return out.withColumn("batch", (F.floor((F.col("_before") + at) / size) + 1).cast("int")).drop("_m", "_p", "_before")


def summary(events: DataFrame) -> DataFrame:
    """One row of counters from rows (action, n_chunks, n_tokens, cost, failed)."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    return events.agg(
        n(F.col("action") == "add").alias("added"), n(F.col("action") == "update").alias("updated"), n(F.col("action") == "skip").alias("skipped"), n(F.col("failed")).alias("failed"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).cast("long").alias("chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("long").alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost_usd"),
    )


def first_rows(articles: DataFrame, key: str = "wiki_id") -> DataFrame:
    """One row of each key, the first in the order of the input: what is seen again in a run is passed over."""
    w = Window.partitionBy(key).orderBy("_row")
    return articles.withColumn("_row", F.monotonically_increasing_id()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_row", "_n")


def ingest(articles: DataFrame, store, embed, metadata, index_path: str | None = None, mode: str = "differs", force: bool = False, dry_run: bool = False):
    """Articles into a store: changed ones are chunked, described, embedded and swapped in; unchanged ones are a no-op.

    Of rows with the same id the first counts.  ``embed`` adds the column ``embedding`` to chunks and ``metadata`` further columns.  An article with
    a failed chunk keeps its stored version; that all articles fail is an error.  The keyword index is then rebuilt from the whole
    store; a failure there is reported, not raised.  Returns counters, tokens and cost as a dict, the run's summary.
    """
    from skein.operators import chunking, keyword
    from skein.operators.embed import usage

    run = uuid.uuid4().hex[:8]
    log.event("ingest_started", run=run, store=store.path, mode=mode, force=force, dry_run=dry_run)
    known = store.versions().withColumnRenamed("wiki_page_id", "wiki_id")
    judged = changes(first_rows(articles), known, mode, force)
    chunks = metadata(chunking.chunk(judged.where("action <> 'skip'")))
    out = {r["action"]: r["count"] for r in judged.groupBy("action").count().collect()}  # three rows at most
    if dry_run:
        return out | {"chunks": chunks.count()}
    made = shared.materialise(embed(chunks.withColumnRenamed("chunk_id", "id")))  # vectors are computed once
    failed = made.where("embedding is null").select("wiki_page_id").distinct()
    sound = made.join(failed, "wiki_page_id", "left_anti")
    used = usage(made).first()
    out |= {"chunks": sound.count(), "failed": failed.count(), "tokens": used["tokens"], "cost_usd": used["cost_usd"]}
    if out["failed"] and not out["chunks"]:
        raise ValidationError("no chunk could be embedded")
    store.replace_articles(sound)
    if index_path and store.count():
        try:
            keyword.build(store.rows().withColumnRenamed("id", "chunk_id"), path=index_path)
        except Exception as e:  # the store is complete; the index can be built again
            out["index_error"] = str(e)
            log.event("keyword_index_failed", run=run, error=str(e))
    log.event("ingest_finished", run=run, **out)
    return out
