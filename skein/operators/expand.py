"""Context expansion: chunks of the articles that hits link to, one or two levels deep.

A batch of queries is one plan: every step carries ``query_id``.  Links are taken in order of
their first mention (rank of the hit, then position); per link the first chunks by index.
Each level's rows (at most ``max_chunks`` a query) are materialised, so no level is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import shared
from skein.session import ExpansionConfig


def link_list(hits: DataFrame, most: int | None = None) -> DataFrame:
    """``(query_id, link, link_pos)``: distinct links of hits (query_id, rank, links), the first ``most`` of each query."""
    each = hits.select("query_id", "rank", F.posexplode("links").alias("p", "link"))
    first = each.groupBy("query_id", "link").agg(F.min(F.struct("rank", "p")).alias("at"))
    placed = first.withColumn("link_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at")))
    return (placed.where(F.col("link_pos") <= most) if most is not None else placed).select("query_id", "link", "link_pos")


def _step(sources: DataFrame, seen: DataFrame, chunks: DataFrame, per_link: int, most: int | None) -> DataFrame:
    """New chunks ``(query_id, chunk_id, pos, links)`` for the links of ``sources``, in order and without those seen."""
    linked = shared.small(shared.materialise(link_list(sources, most)))
    # only linked articles' chunks are shuffled; the per-link limit comes before the seen filter
    named = linked.select(F.col("link").alias("article_title"))
    order = Window.partitionBy("article_title").orderBy("chunk_index", "chunk_id")
    top = chunks.join(named, "article_title", "left_semi").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_link)
    found = linked.join(top, F.col("link") == F.col("article_title")).select("query_id", "chunk_id", "link_pos", "n", "links")
    fresh = found.join(seen, ["query_id", "chunk_id"], "left_anti")
    once = fresh.groupBy("query_id", "chunk_id").agg(F.min(F.struct("link_pos", "n")).alias("at"), F.first("links").alias("links"))
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).drop("at")


def expand(hits: DataFrame, chunks: DataFrame, config: ExpansionConfig = ExpansionConfig()) -> DataFrame:
    """``(query_id, chunk_id, score, place, depth)``: hits with their scores, then expanded chunks with score 0.

    ``hits`` has (query_id, chunk_id, score, rank); ``chunks`` has (chunk_id, article_title,
    chunk_index, links); hits without a stored chunk go.  The result has at most ``max_chunks`` rows for a query.
    """
    base = shared.small(shared.materialise(hits.join(chunks.select("chunk_id", "links"), "chunk_id").select("query_id", "chunk_id", "score", "rank", "links")))
    out = base.select("query_id", "chunk_id", "score", F.lit(0).alias("depth"), F.col("rank").alias("pos"))
    if config.depth >= 1:
        one = _step(base, base.select("query_id", "chunk_id"), chunks, config.per_link_1, config.max_chunks)
        held = base.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
        one = one.join(held, "query_id").where(F.col("pos") <= config.max_chunks - F.col("held")).drop("held")
        one = shared.small(shared.materialise(one)) if config.depth == 2 else one
        out = out.unionByName(one.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(1).alias("depth"), "pos"))
        if config.depth == 2:
            seen = out.select("query_id", "chunk_id")
            two = _step(one.withColumnRenamed("pos", "rank"), seen, chunks, config.per_link_2, None)
            out = out.unionByName(two.select("query_id", "chunk_id", F.lit(0.0).alias("score"), F.lit(2).alias("depth"), "pos"))
    order = Window.partitionBy("query_id").orderBy("depth", "pos")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.max_chunks).select("query_id", "chunk_id", "score", "place", "depth")
