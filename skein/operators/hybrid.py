"""Hybrid retrieval: keyword and vector lists fused by weighted reciprocal ranks."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import log, shared
from skein.operators import keyword, vector
from skein.session import HybridConfig


def fuse(vector_hits: DataFrame, keyword_hits: DataFrame, config: HybridConfig = HybridConfig(), k: int | None = None) -> DataFrame:
    """``(query_id, chunk_id, score, rank)`` from two ranked lists (query_id, chunk_id, rank).

    A row's score is the sum of weight / (constant + rank) over the lists that hold it.  Ties:
    rows of the vector list first, by their rank there, then the others by keyword rank.
    ``k`` of 0 or none means the configured number.
    """
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("v_rank"))
    b = keyword_hits.select("query_id", "chunk_id", F.col("rank").alias("b_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(config.rrf_constant) + F.col(rank)), F.lit(0.0))
    both = v.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(part("v_rank", config.vector_weight) + part("b_rank", config.keyword_weight), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("v_rank"), F.asc_nulls_last("b_rank"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (k or config.top_k)).select("query_id", "chunk_id", "score", "rank")


def with_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns, joined after the cut; hits without a stored chunk go."""
    return hits.join(chunks, "chunk_id")


def retrieve(index: keyword.KeywordIndex, vectors: DataFrame, queries: DataFrame, query_vectors: dict, config: HybridConfig = HybridConfig(), k: int | None = None, filters: dict | None = None, timed: bool = False) -> DataFrame:
    """Both searches and their fusion for queries (query_id, text) with vectors ``{query_id: vector}``.

    Filters restrict the vector list only.  ``timed`` runs the two searches one after the other and logs how long each took.
    """
    k = k or config.top_k

    def branch(name: str, search) -> DataFrame:
        began = time.perf_counter()
        found = search()
        if timed:
            found = shared.materialise(found)
            log.event("search_branch", branch=name, seconds=round(time.perf_counter() - began, 3))
        return found

    def nearest() -> DataFrame:
        if len(query_vectors) > 1:
            return vector.search_batch(vectors, query_vectors, k, filters)
        ((name, one),) = query_vectors.items()  # a single vector is an expression, without a Python worker
        return vector.search(vectors, one, k, filters).withColumn("query_id", F.lit(name))

    found = fuse(branch("vector", nearest), branch("keyword", lambda: keyword.search(index, queries, k)), config, k)
    return F.broadcast(found) if k * len(query_vectors) <= shared.SMALL else found  # at most k rows a query: rows are joined to hits without a shuffle
