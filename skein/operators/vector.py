"""Exact cosine search.

One query is a column expression with the query's vector as a literal, so filters reach the
scan and the top rows are a ``TakeOrderedAndProject``.  A batch of queries is a numpy matrix
product per Arrow batch; a partition hands on only its best rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import ValidationError

#: A batch of query vectors must stay below this many numbers (64 MB).
MOST_NUMBERS = 8 << 20
#: Rows of a block of queries and of candidates in ``search_table``.
BLOCK, SHARD = 4096, 65536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, in doubles; null where a norm is 0."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def where_equal(rows: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that equal all the filters' values; no filter, no change."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(c) == F.lit(v) for c, v in filters.items()))) if filters else rows


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, filters: dict | None = None, id_column: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``(id, distance, rank)`` of the ``k`` nearest rows, ties by id; zero vectors have no distance and go."""
    if not len(query):
        raise ValidationError("the query vector is empty")
    literal = F.array(*(F.lit(float(x)) for x in query))
    norm = F.lit(reduce(lambda s, x: s + x * x, map(float, query), 0.0) ** 0.5)
    distance = 1 - dot(F.col(vector), literal) / F.nullif(F.sqrt(dot(F.col(vector), F.col(vector))) * norm, F.lit(0.0))  # cosine_distance, with the query's norm computed once
    near = where_equal(vectors, filters).select(F.col(id_column), (F.round(distance, 6) + 0.0).alias("distance"))
    # rows without a distance go after the cut: a filter before it would compute every distance twice
    near = near.orderBy(F.asc_nulls_last("distance"), id_column).limit(k).where("distance is not null")
    return near.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_column)))  # over k rows


def _first(query: np.ndarray, ids: np.ndarray, distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest rows of each query, ties by id."""
    order = np.lexsort((ids, distance, query))
    query, ids, distance = query[order], ids[order], distance[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[top], ids[top], distance[top]


def search_batch(vectors: DataFrame, queries: dict, k: int = 10, filters: dict | None = None, id_column: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, id, distance, rank)`` for a batch of queries ``{query_id: vector}`` of bounded size."""
    names = list(queries)
    matrix = np.array([queries[n] for n in names], np.float64)
    if matrix.size > MOST_NUMBERS:
        raise ValidationError("too many query vectors for one batch; split them")
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    kind = vectors.schema[id_column].dataType.simpleString()

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (query number, id, distance) of the partition's best rows so far
        for rows in batches:
            x = np.array(rows["v"].tolist(), np.float64)
            if not len(x):
                continue
            norm = np.linalg.norm(x, axis=1)
            distance = np.round(1 - (x @ matrix.T) / np.where(norm > 0, norm, np.nan)[:, None], 6) + 0.0
            distance[np.isnan(distance)] = np.inf
            bar = np.partition(distance, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1]
            row, query = np.nonzero((distance <= bar) & np.isfinite(distance))
            new = (query, rows["id"].to_numpy()[row], distance[row, query])
            held = _first(*(new if held is None else map(np.concatenate, zip(held, new))), k)
        if held is not None and len(held[0]):
            yield pd.DataFrame({"query_id": [names[j] for j in held[0]], id_column: held[1], "distance": held[2]})

    rows = where_equal(vectors, filters).select(F.col(id_column).alias("id"), F.col(vector).alias("v")).where("v is not null")
    near = rows.mapInPandas(best, f"query_id {'string' if isinstance(names[0], str) else 'long'}, `{id_column}` {kind}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", id_column)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_table(vectors: DataFrame, queries: DataFrame, k: int = 10, filters: dict | None = None, id_column: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``(query_id, id, distance, rank)`` for a table of queries (query_id, vector) of any size.

    Both sides are dealt into blocks of bounded size by a hash; each pair of blocks is one matrix
    product, whose ``k`` nearest rows of each query go on.  Rows and queries without a vector, or with a zero one, go.
    """
    rows = where_equal(vectors, filters).select(F.col(id_column).alias("id"), F.col(vector).cast("array<float>").alias("v")).where("v is not null")
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("v")).where("v is not null")
    blocks, shards = max(1, -(-asked.count() // BLOCK)), max(1, -(-rows.count() // SHARD))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", "v", place("query_id", blocks).alias("block"), every(shards).alias("shard"))
    right = rows.select("id", "v", place("id", shards).alias("shard"), every(blocks).alias("block"))
    kinds = {n: rows_.schema[c].dataType.simpleString() for n, rows_, c in (("query", queries, "query_id"), ("id", vectors, id_column))}

    def nearest(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": q["query_id"].iloc[:0], id_column: x["id"].iloc[:0], "distance": np.zeros(0)})
        if len(q) and len(x):
            a, b = (np.array(side["v"].tolist(), np.float64) for side in (q, x))
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
            parts = []
            for at in range(0, len(a), 256):
                distance = np.round(1 - a[at : at + 256] @ b.T, 6) + 0.0
                distance[np.isnan(distance)] = np.inf
                bar = np.partition(distance, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                r, c = np.nonzero((distance <= bar[:, None]) & np.isfinite(distance))
                parts.append((r + at, x["id"].to_numpy()[c], distance[r, c]))
            r, ids, distance = _first(*map(np.concatenate, zip(*parts)), k)
            out = pd.DataFrame({"query_id": q["query_id"].to_numpy()[r], id_column: ids, "distance": distance})
        return out

    near = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInPandas(nearest, f"query_id {kinds['query']}, `{id_column}` {kinds['id']}, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", id_column)
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
