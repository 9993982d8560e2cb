"""Command line: ``python -m skein.cli COMMAND``.  Every command is a thin call of the library."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import log, shared
from skein.operators import analytics, chunking, embed, expand, hybrid, ingest, keyword, links, metadata
from skein.operators.store import ChunkStore
from skein.session import ExpansionConfig, HybridConfig, KeywordConfig, NotFoundError, from_env, session
from skein.sources import archive, wiki


def _ids(spark: SparkSession, path: str | None, comments: bool = True) -> DataFrame | None:
    return archive.id_table(spark, path, comments) if path else None


def _embed(a: argparse.Namespace):
    return lambda chunks: embed.embed(chunks, embed.hashing(a.dimensions))


def _show(rows: DataFrame) -> None:
    for r in rows.collect():
        print("\t".join(map(str, r)))


def parse_wiki(spark: SparkSession, a: argparse.Namespace) -> None:
    """Convert an XML export: a Parquet table of articles, and with --files a Markdown archive."""
    made = wiki.articles(spark, a.xml, _ids(spark, a.page_ids, comments=False))
    made.write.mode("overwrite").parquet(a.output)
    if a.files:
        archive.write(spark.read.parquet(a.output), a.files)
    print(spark.read.parquet(a.output).count(), "articles")


def build_test_bed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Choose pages around a seed by breadth-first search, and write their ids."""
    raw = wiki.pages(spark, a.xml).cache()
    titles = wiki.titles(raw)
    places = links.breadth_first(wiki.edges(raw), titles, a.seed, a.count)
    archive.write_id_list(links.titled(places, titles), a.output, a.seed)
    _show(places.agg(F.count(F.lit(1)), F.max("depth")))
    raw.unpersist()


def _articles(spark: SparkSession, path: str, ids: DataFrame | None) -> DataFrame:
    """Articles of a Parquet table or of a Markdown archive."""
    if archive.files(spark, path).select("path").take(1):
        return archive.load(spark, path, ids)
    rows = spark.read.parquet(path)
    return rows.join(ids.select(F.col("id").alias("wiki_id")), "wiki_id", "left_semi") if ids is not None else rows


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Articles into the store: only changed ones, unless --force; --dry-run stops before embedding."""
    out = ingest.ingest(_articles(spark, a.articles, _ids(spark, a.wiki_ids)), ChunkStore(spark, a.store), _embed(a), metadata.extract, a.index, "differs", a.force, a.dry_run)
    print(json.dumps(out))
    if a.summary:
        spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(a.summary)


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks with metadata of articles, as Parquet."""
    metadata.extract(chunking.chunk(_articles(spark, a.articles, _ids(spark, a.wiki_ids)))).write.mode("overwrite").parquet(a.output)
    print(spark.read.parquet(a.output).count(), "chunks")


def run_embed(spark: SparkSession, a: argparse.Namespace) -> None:
    """Vectors of chunks, as Parquet."""
    _embed(a)(spark.read.parquet(a.chunks)).write.mode("overwrite").parquet(a.output)
    _show(embed.usage(spark.read.parquet(a.output)))


def run_store(spark: SparkSession, a: argparse.Namespace) -> None:
    """Embedded chunks into the store: new articles, and newer ones (or all with --force).

    Without a change nothing is written, unless the keyword index is missing; that it can't be made is a warning.
    """
    store = ChunkStore(spark, a.store)
    rows = spark.read.parquet(a.embeddings).where("embedding is not null").withColumnRenamed("chunk_id", "id")
    versions = rows.groupBy(F.col("wiki_page_id").alias("wiki_id")).agg(F.min_by("article_last_updated", "chunk_index").alias("last_updated"))
    known = store.versions().withColumnRenamed("wiki_page_id", "wiki_id")
    judged = shared.materialise(ingest.changes(versions, known, "newer", a.force))
    counted = {r["action"]: r["count"] for r in judged.groupBy("action").count().collect()}
    for action, n in sorted(counted.items()):
        print(f"{action}\t{n}")
    changed = bool(counted.keys() - {"skip"})
    if changed:
        store.replace_articles(rows.join(judged.where("action <> 'skip'").select(F.col("wiki_id").alias("wiki_page_id")), "wiki_page_id", "left_semi"))
    elif not a.index or shared.exists(spark, f"{a.index}/stats/_SUCCESS"):
        print("nothing to store")
        return
    if a.index:
        try:
            keyword.build(store.rows().withColumnRenamed("id", "chunk_id"), lowercase=from_env(KeywordConfig, "BM25_").tokenize_lowercase, path=a.index)
        except Exception as e:  # the rows are stored; build-bm25 makes the index later
            log.event("keyword_index_failed", error=str(e))
            print(f"warning: the chunks are stored, but no keyword index could be made: {e}", file=sys.stderr)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of a store or of a Parquet table."""
    return ChunkStore(spark, path).rows() if shared.exists(spark, f"{path}/_manifests") else spark.read.parquet(path)


def build_bm25(spark: SparkSession, a: argparse.Namespace) -> None:
    """A keyword index of chunks (a store, or a Parquet table of chunks)."""
    rows = _chunks(spark, a.chunks)
    config = from_env(KeywordConfig, "BM25_")
    made = keyword.build(rows.withColumnRenamed("id", "chunk_id") if "id" in rows.columns else rows, lowercase=a.lowercase or config.tokenize_lowercase, path=a.output or config.index_path)
    _show(keyword.stats(made))


def stats_markdown(spark: SparkSession, a: argparse.Namespace) -> None:
    """Sizes of an archive's articles, with the smallest and largest."""
    rows = _articles(spark, a.articles, None)
    _show(analytics.sizes(rows, "word_count"))
    _show(analytics.extremes(rows, "word_count", "title"))


def stats_db(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chunks by article, with the smallest and largest, and the latest version."""
    rows = ChunkStore(spark, a.store).rows()
    by = rows.groupBy("article_title").agg(F.count(F.lit(1)).alias("chunks"))
    _show(analytics.sizes(by, "chunks"))
    _show(analytics.extremes(by, "chunks", "article_title"))
    _show(analytics.latest(rows, "article_last_updated"))


def show_chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """A chunk's text, tokens and metadata."""
    row = ChunkStore(spark, a.store).get(a.chunk_id).first().asDict()
    text = row.pop("chunk_text")
    row.pop("embedding")
    print(text, f"\ntokens: {chunking.estimate(text)}")
    for key in sorted(row):
        print(f"{key}: {row[key]}")


def delete_chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    """Delete a chunk, after a question unless --force."""
    store = ChunkStore(spark, a.store)
    store.get(a.chunk_id)
    if a.force or input(f"delete {a.chunk_id}? [y/N] ").strip().lower() == "y":
        store.delete_chunk(a.chunk_id)
        print("deleted")


def db_health(spark: SparkSession, a: argparse.Namespace) -> None:
    """The store's state; exit code 1 if it can't be read."""
    state = ChunkStore(spark, a.store).health()
    print(json.dumps(state))
    if state["status"] != "healthy":
        sys.exit(1)


def purge_db(spark: SparkSession, a: argparse.Namespace) -> None:
    """Delete all chunks, after typing DELETE ALL unless --force."""
    store = ChunkStore(spark, a.store)
    if store.count() and (a.force or input("type DELETE ALL: ").strip() == "DELETE ALL"):
        print(store.purge(), "deleted")
    else:
        print("nothing deleted")


def retrieve(spark: SparkSession, a: argparse.Namespace) -> None:
    """Hybrid search for a question, with context expansion."""
    store = ChunkStore(spark, a.store)
    rows = store.rows().withColumnRenamed("id", "chunk_id")
    if not rows.take(1):
        raise NotFoundError("the store is empty")
    asked = spark.createDataFrame([(0, a.text)], "query_id long, text string")
    vector = embed.hashing(a.dimensions)()([a.text])[0]
    hits = hybrid.retrieve(keyword.load(spark, a.index), rows, asked, {0: [float(v) for v in vector]}, from_env(HybridConfig, "HYBRID_"), a.top_k, timed=a.timed)
    hits = hybrid.with_rows(hits, rows.select("chunk_id")).select("query_id", "chunk_id", "score", "rank")
    found = expand.expand(hits, rows.select("chunk_id", "article_title", "chunk_index", "links"), replace(from_env(ExpansionConfig, "EXPANSION_"), **{k: v for k, v in (("depth", a.depth), ("max_chunks", a.max_chunks)) if v is not None}))
    shown = found.join(rows, "chunk_id").orderBy("place")
    from skein.functions.text import preview

    _show(shown.select("place", "score", "chunk_id", "article_title", "section_path", F.regexp_replace(preview(F.col("chunk_text")), "\n", " ").alias("preview")))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run, *arguments: str, **options) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=run.__doc__)
        for x in arguments:
            p.add_argument(x)
        for key, default in options.items():
            flag = "--" + key.replace("_", "-")
            kind = int if key in ("depth", "max_chunks") else type(default) if default is not None else str
            p.add_argument(flag, action="store_true") if default is False else p.add_argument(flag, default=default, type=kind)
        p.set_defaults(run=run)
        return p

    size = {"dimensions": embed.DIMENSIONS}
    add("parse-wiki", parse_wiki, "xml", "output", page_ids=None, files=None)
    add("build-test-bed", build_test_bed, "xml", "output", seed="58", count=100)
    add("ingest", run_ingest, "articles", "store", wiki_ids=None, index=None, force=False, dry_run=False, summary=None, **size)
    add("chunk", chunk, "articles", "output", wiki_ids=None)
    add("embed", run_embed, "chunks", "output", **size)
    add("store", run_store, "embeddings", "store", index=None, force=False)
    add("build-bm25", build_bm25, "chunks", output=None, lowercase=False)
    add("stats-markdown", stats_markdown, "articles")
    add("stats-db", stats_db, "store")
    add("show-chunk", show_chunk, "store", "chunk_id")
    add("delete-chunk", delete_chunk, "store", "chunk_id", force=False)
    add("db-health", db_health, "store")
    add("purge-db", purge_db, "store", force=False)
    add("retrieve", retrieve, "store", "index", "text", top_k=0, depth=None, max_chunks=None, timed=False, **size)
    return top


def dispatch(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; errors are raised."""
    a = parser().parse_args(arguments)
    began = time.perf_counter()
    log.event("command_started", command=a.command)
    a.run(spark or session(), a)
    log.event("command_finished", command=a.command, seconds=round(time.perf_counter() - began, 3))
    return 0


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command with logging to standard error; an error gives exit code 1."""
    log.setup()
    try:
        return dispatch(arguments, spark)
    except Exception as e:
        log.logger.error("command_failed", extra={"fields": {"error": str(e)}}, exc_info=True)
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
