"""Exact top-k by inner product, without random access to the lists until the end.

Method: no-random-access aggregation.  A query's score is a sum over components, and the
candidates, sorted by each component's contribution, are one list per component.  Lists are read in step
to growing depths, from a fifth of a list on.  A candidate's lower bound takes the contributions read
so far and each unread list's last value; its upper bound takes each unread list's next
value instead.  Both grow or shrink by what was newly read.  When few candidates have an
upper bound that reaches the k-th best score known so far, the outsiders can't qualify any
more: that query stops reading, and the scores of the candidates left are resolved exactly.

Candidates come in slices: the first is short and its lists are read to the end, each next one
has twice as many rows as the one before.  The k-th best resolved score of the slices so far
is a lower bound on the k-th best of all, so later and larger slices stop earlier.

Bounds of a block of queries are matrix products: with ``t`` the next unread value of a
list, a candidate's part is max(value, t).  Positive and negative query components read a
list from its two ends, so a query is the two halves (positive parts, negated negative ones) of one row.

Queries and candidates are dealt into blocks of bounded size by a hash of the row; each pair
of blocks is one group, its k best per query are kept, and a window picks the k best of
those.  Nothing is broadcast or sent to the driver but two row counts.

Defined cases: vectors that are null or hold null or non-finite components take no part,
nor do rows without an id; every other row is a candidate and, if its id is a query's, a query of its
own, also where ids or whole rows repeat; shorter vectors are filled up with zeros; ties go to the smaller id; a query with fewer
candidates than k returns all of them; scores that don't fit 64 bits are an error; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut

K, DIVISOR, SCALE = 20, 20, 64
#: Rows of a block of candidates and of queries; queries bounded at once; rows of the first slice.
CANDIDATES, QUERIES, STEP, SLICE = 8192, 32768, 256, 256
#: Depths that are read, as shares of a list; the end is always the last.
DEPTHS = (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.88, 0.94)
#: A query stops when at most this share of a slice (or 2k candidates) can still qualify.
OPEN = 1 / 16


def _matrix(vectors: pd.Series, scale: int, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.float64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(scale * out)


def _sides(x: np.ndarray) -> np.ndarray:
    """A query as its positive parts and its negated negative ones."""
    return np.concatenate([np.maximum(x, 0), np.maximum(-x, 0)], axis=1)


class Lists:
    """The sorted lists of a slice's candidates, and what a reading to some depth tells of their contributions."""

    def __init__(self, x: np.ndarray, kind: type):
        self.x, self.kind, self.sorted = x, kind, np.sort(x, axis=0)
        self.parts: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def read(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds of each candidate's contribution per unit of a query's sides; equal at depth 1."""
        if depth not in self.parts:
            x, n = self.x, len(self.x)
            if depth >= 1:
                upper = lower = np.concatenate([x, -x], axis=1)
            else:
                at = int(depth * n)
                down, up = self.sorted[n - 1 - at], self.sorted[at]  # the next unread values from either end
                upper = np.concatenate([np.maximum(x, down), np.maximum(-x, -up)], axis=1)
                lower = np.concatenate([np.where(x > down, x, self.sorted[0]), np.where(x < up, -x, -self.sorted[-1])], axis=1)
            self.parts[depth] = upper.T.astype(self.kind), lower.T.astype(self.kind)
        return self.parts[depth]


def best(ids: np.ndarray, rows: np.ndarray, x: np.ndarray, query_rows: np.ndarray, q: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS, trace: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, candidate, score)`` of each query's k best among the candidates, but for its own row; both as positions.

    ``trace`` receives (queries that stopped, candidates of the slice, depth at which they stopped).
    """
    n, width = x.shape
    most = max(1.0, float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * width)
    kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
    wide, least = (np.int64, np.iinfo(np.int64).min) if kind is np.int64 else (np.float64, -np.inf)
    if most >= 2**62:
        raise ValueError("scores don't fit 64 bits")
    order = np.argsort(ids, kind="stable")
    x, position = x[order], pd.Index(rows[order])
    own, sides = position.get_indexer(query_rows), _sides(q).astype(kind)
    bar = np.full(len(q), least, wide)  # the k-th best resolved score
    held = (np.zeros(0, int), np.zeros(0, int), np.zeros(0, wide))
    at, size = 0, max(SLICE, 4 * k)
    while at < n:
        lists = Lists(x[at : at + size], kind)
        found = [held]
        for s in range(0, len(q), STEP):
            found += _slice(lists, sides[s : s + STEP], own[s : s + STEP] - at, bar[s : s + STEP], k, (*depths, 1.0) if at else (1.0,), wide, least, s, at, trace)
        held = _first(*(np.concatenate(a) for a in zip(*found)), k)
        last = np.flatnonzero(np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) == k - 1)
        bar[held[0][last]] = held[2][last]
        at, size = at + size, 2 * size
    return held[0], order[held[1]], held[2]


def _slice(lists: Lists, sides: np.ndarray, own: np.ndarray, bar: np.ndarray, k: int, depths: tuple[float, ...], wide: type, least, shift: int, at: int, trace: list | None) -> list[tuple]:
    """One slice's candidates that can be among a query's k best, with their scores: read to growing depths, stop per query, resolve."""
    n, out = len(lists.x), []
    open_ = np.arange(len(sides))
    upper = lower = np.zeros((len(sides), n), lists.kind)
    before = (0, 0)
    for depth in depths:
        now = lists.read(depth)
        upper, lower = (b + sides[open_] @ (new - old) for b, new, old in zip((upper, lower), now, before))
        before = now
        mine = np.flatnonzero((own[open_] >= 0) & (own[open_] < n))
        known = bar[open_]
        if n > k:
            low = lower.copy()
            low[mine, own[open_][mine]] = least
            known = np.maximum(known, np.partition(low, n - k, axis=1)[:, n - k])
        may = upper >= known[:, None]
        may[mine, own[open_][mine]] = False
        done = (may.sum(axis=1) <= max(2 * k, int(OPEN * n))) | (depth >= 1)
        if trace is not None and done.any():
            trace.append((int(done.sum()), n, depth))
        r, c = np.nonzero(may[done])
        query = open_[done][r]
        score = upper[done][r, c].astype(wide) if depth >= 1 else np.concatenate([np.zeros(0, wide), *(_scores(lists.x, sides, query[i : i + 65536], c[i : i + 65536], wide) for i in range(0, len(c), 65536))])
        out.append((query + shift, c + at, score))
        open_, upper, lower = open_[~done], upper[~done], lower[~done]
        if not len(open_):
            break
    return out


def _scores(x: np.ndarray, sides: np.ndarray, query: np.ndarray, candidate: np.ndarray, wide: type) -> np.ndarray:
    """Final scores of pairs: the only random access."""
    width = x.shape[1]
    q = sides[query].astype(wide)
    return np.einsum("ij,ij->i", q[:, :width] - q[:, width:], x[candidate].astype(wide))


def _first(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by score, then candidate (candidates are in order of their ids)."""
    order = np.lexsort((column, -score, row))
    row, column, score = row[order], column[order], score[order]
    top = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[top], column[top], score[top]


def search(vectors: DataFrame, k: int = K, divisor: int = DIVISOR, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best other rows of ``vectors`` (vec_id, embedding)."""
    sound = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    light = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.where(F.col("vec_id").isNotNull()).where(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(light).alias("embedding"))
    rows = cut(rows)  # rows are told apart by numbers, which must not change
    is_query = F.pmod("vec_id", F.lit(divisor)) == 0
    n, m, width = rows.agg(F.count("*"), F.sum(is_query.cast("long")), F.max(F.size("embedding"))).first()
    shards, blocks = max(1, -(-n // CANDIDATES)), max(1, -(-(m or 0) // QUERIES))
    place = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    candidates = rows.select("row", "vec_id", "embedding", place(1, shards).alias("shard"), every(blocks).alias("block"))
    queries = rows.where(is_query).select("row", "vec_id", "embedding", place(2, blocks).alias("block"), every(shards).alias("shard"))
    width = width or 1

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = right["vec_id"].to_numpy()
        q, c, s = best(ids, right["row"].to_numpy(), _matrix(right["embedding"], scale, width), left["row"].to_numpy(), _matrix(left["embedding"], scale, width), k)
        return pd.DataFrame({"row": left["row"].to_numpy()[q], "query_id": left["vec_id"].to_numpy()[q], "vec_id": ids[c], "score": [int(v) for v in s]})

    near = queries.groupBy("block", "shard").cogroup(candidates.groupBy("block", "shard")).applyInPandas(cell, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the rows of ``search`` over ``embeddings``.
ORACLE_SQL = """
with sound as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::double) as v from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scored as (
  select q.n, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from sound q join sound c on q.vec_id % 20 = 0 and q.n <> c.n),
ranked as (select *, row_number() over (partition by n order by score desc, vec_id) as rank from scored)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20"""
