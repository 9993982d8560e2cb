"""Near duplicates by SimHash: fingerprints, links within a radius, connected groups.

Method: tiled exact comparison with numpy exclusive-or and bit counts; tile pairs whose
population counts differ by more than the radius are skipped.

1. A fingerprint per text is made in one pass without a shuffle.
2. Equal fingerprints are brought together first (a pre-aggregated ``groupBy``), so a
   group of exact copies is one row afterwards.
3. Fingerprints are dealt into tiles by the population counts of their four 16-bit words.
   The driver sees only the histogram of those counts (at most 17^4 cells, whatever the
   input) and lays out the tiles: ``LEAST_TILES``, or more where a tile would have more than
   ``TILE`` rows.  So each fingerprint goes to a number of pairs that doesn't depend on the
   input up to ``LEAST_TILES * TILE`` fingerprints.  Two fingerprints differ in at least
   as many bits as their counts differ, summed over the words, so a pair of tiles whose
   counts are further apart than the radius holds no link and is never formed.
4. Each pair of tiles is one group of rows: blocks of it are compared exactly.  Only a
   spanning forest of its links leaves the task: at most one edge per fingerprint, whatever
   the size of a group of near copies, and with the same connected groups.
5. Groups are joined across tiles by label propagation with shortcuts, on the linked
   fingerprints only; every round is written to the shared checkpoint folder.

Comparing all tiles is quadratic in the number of distinct fingerprints, which is in the
method's nature; blocks inside a pair of tiles are skipped by the same counts.

Defined cases: a null or empty text has fingerprint zero and is linked like any other;
fewer words than a shingle give one shingle; an empty table gives no rows; rows without
an id take part, and a group of none but such rows has a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.llm.common import cut, map_arrow, slices

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Tiles at least and at most, fingerprints of a tile between these, rows and columns compared at once.
LEAST_TILES, MOST_TILES, TILE, BLOCK = 32, 2048, 1 << 20, 512
#: A fingerprint of more than 1/HOT of all rows finds its group by a broadcast.
HOT = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = (starts[: 1 - shingle], ends[shingle - 1 :]) if len(words) >= shingle else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[a:b], seed) for a, b in zip(first.tolist(), last.tolist())], np.uint64, len(first))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, fp)``: each row's fingerprint as a signed 64-bit integer."""

    def run(rows: dict) -> dict:
        fps = np.array([fingerprint(t or b"") for t in rows["text"]], np.uint64)
        return {"id": rows["id"], "fp": fps.view(np.int64)}

    return map_arrow(docs.selectExpr(f"`{id_column}` id", "cast(cast(text as string) as binary) text"), run, f"id {docs.schema[id_column].dataType.simpleString()}, fp long")


def _counts(fp: str = "fp") -> list[F.Column]:
    return [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)).cast("int").alias(f"p{k}") for k in range(4)]


def _layout(cells: list[tuple[int, int, int, int, int]], tiles: int, radius: int) -> tuple[list[tuple], list[tuple[int, list[int]]]]:
    """Cells to tiles ``(p0..p3, first, spread)``, and each tile's pairs ``(tile, ids)``.

    Small cells share a tile; a cell of more than a tile's rows is spread over several.
    """
    size = math.ceil(sum(c[4] for c in cells) / tiles)
    where, boxes, room = [], [], 0
    for *p, n in sorted(cells):
        spread = max(1, math.ceil(n / size))
        if spread > 1 or n > room:
            first, room = len(boxes), (size if spread == 1 else 0)
            boxes += [[p[:], p[:]] for _ in range(spread)]
        else:
            first = len(boxes) - 1
            boxes[first] = [[min(a, b) for a, b in zip(boxes[first][0], p)], [max(a, b) for a, b in zip(boxes[first][1], p)]]
        room -= n
        where.append((*p, first, spread))
    low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
    pairs: list[list[int]] = [[] for _ in boxes]
    for i in range(len(boxes)):
        apart = np.maximum(0, np.maximum(low[i] - high[i:], low[i:] - high[i])).sum(axis=1)
        for j in (i + np.flatnonzero(apart <= radius)).tolist():
            pair = i * (len(boxes) + 1) + j
            pairs[i].append(pair)
            if j != i:
                pairs[j].append(pair)
    return where, list(enumerate(pairs))


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the edges ``(a, b)`` and earlier ``label``s."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new[label], label):
            return label
        label = new[label]


def forest_of_links(fp: np.ndarray, left: np.ndarray, radius: int = RADIUS, block: int = BLOCK) -> np.ndarray:
    """For distinct fingerprints ``fp``: the index of each one's root, linking rows of ``left`` to the others.

    Where every row is in ``left`` the rows are compared with each other.  Rows are taken
    by the population counts of their words, and blocks whose counts differ by more than the radius are skipped.
    """
    words = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    order = np.lexsort(words.T[::-1])
    fp_s, words, side = fp[order], words[order], left[order]
    same = bool(side.all())
    rows, columns = (np.arange(len(fp)),) * 2 if same else (np.flatnonzero(side), np.flatnonzero(~side))
    at = np.arange(0, len(columns), block)
    low, high = (f.reduceat(words[columns], at, axis=0) for f in (np.minimum, np.maximum)) if len(at) else (words[:0], words[:0])
    label = np.arange(len(fp))
    for i in range(0, len(rows), block):
        r = rows[i : i + block]
        apart = np.maximum(0, np.maximum(low - words[r].max(axis=0), words[r].min(axis=0) - high)).sum(axis=1)
        for j in (at[(apart <= radius) & (at >= i)] if same else at[apart <= radius]).tolist():
            c = columns[j : j + block]
            near = np.bitwise_count(fp_s[r][:, None] ^ fp_s[c][None, :]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                label = _roots(len(fp), r[a], c[b], label)
    out = np.empty(len(fp), np.int64)
    out[order] = order[label]
    return out


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints ``fps.fp`` that connect just what lies within ``radius``."""
    spark = fps.sparkSession
    celled = fps.select("fp", *_counts())
    cells = [tuple(r) for r in celled.groupBy("p0", "p1", "p2", "p3").count().collect()]  # at most 17^4 rows
    total = sum(c[4] for c in cells)
    where, pairs = _layout(cells, min(MOST_TILES, max(LEAST_TILES, -(-total // tile))), radius)
    names = "p0 int, p1 int, p2 int, p3 int, first int, spread int"
    tiles = spark.createDataFrame(where, names)
    pair_of = spark.createDataFrame(pairs, "tile int, pairs array<long>")
    dealt = (
        celled.join(F.broadcast(tiles), ["p0", "p1", "p2", "p3"])
        .select("fp", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("spread"))).cast("int").alias("tile"))
        .join(F.broadcast(pair_of), "tile")
        .select("fp", "tile", F.explode("pairs").alias("pair"))
    )

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64)
        root = forest_of_links(fp.view(np.uint64), (rows["tile"] == rows["tile"].min()).to_numpy(), radius)
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    return dealt.groupBy("pair").applyInPandas(compare, "a long, b long")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(fp, root, least)``: the smallest fingerprint and the smallest ``nodes.least`` reachable over ``edges``, for fingerprints with an edge.

    Each round takes the smallest label among neighbours, then the label of the label's
    own fingerprint, so that long chains shorten fast; rounds end when no label changes.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    if not both.take(1):
        return nodes.select("fp", F.col("fp").alias("root"), "least").limit(0)
    label = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("fp"), F.least("a", "m").alias("label")))
    while True:
        heard = both.join(label, both.b == label.fp).groupBy("a").agg(F.min("label").alias("heard"))
        new = label.join(heard, label.fp == heard.a, "left").select("fp", "label", F.least("label", "heard").alias("near"))
        via = label.select(F.col("fp").alias("via"), F.col("label").alias("far"))
        new = cut(new.join(via, new.near == via.via, "left").select("fp", F.least("near", "far").alias("label"), (F.least("near", "far") < F.col("label")).alias("moved")))
        moved = new.where("moved").take(1)
        label = new.select("fp", "label")
        if not moved:
            break
    held = label.join(nodes.select("fp", "least"), "fp")
    least = held.groupBy("label").agg(F.min("least").alias("least"))
    return label.join(least, "label").select("fp", F.col("label").alias("root"), "least")


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, n, least, root, component_id)`` for each distinct fingerprint of ``rows`` (id, fp), materialised.

    ``n`` rows have it, ``least`` is their smallest id; ``root`` names its group and ``component_id`` is the group's smallest id.
    """
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    linked = components(links(nodes, radius), nodes)
    return cut(nodes.join(linked.withColumnRenamed("least", "reach"), "fp", "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"), F.coalesce("reach", "least").alias("component_id")))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs`` (id column, text)."""
    rows = cut(fingerprints(docs, id_column))
    of = grouped(rows, radius)
    # a fingerprint with more than 1/HOT of all rows: there are fewer than HOT of them, so they may be broadcast
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = of.where(F.col("n") * HOT > total).select("fp", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot"))
    # a flag of its own tells the two apart: a group of none but rows without an id has a null component
    placed = rows.join(F.broadcast(hot), "fp", "left")
    rest = placed.where("is_hot is null").join(of.where(F.col("n") * HOT <= total).select("fp", "component_id"), "fp").select("id", "fp", "component_id")
    return placed.where("is_hot").select("id", "fp", F.col("hot_id").alias("component_id")).unionByName(rest).select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__fp``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index("text")).cast(pa.string()).cast(pa.binary()).to_pylist()
                fps = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fps, pa.int64())], names=[*part.schema.names, "__fp"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("__fp", LongType())]))


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_column: str = "doc_id") -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, then the smallest fingerprint; rows without an id come last.

    Rows are told apart by id and fingerprint, so rows that repeat an id with another text
    are judged each by itself.  Of rows equal in both, one stays.
    """
    rows = cut(fingerprints(docs, id_column))
    of = grouped(rows, radius)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), "fp")).alias("first")
    kept = cut(of.groupBy("root").agg(first).select("first.id", "first.fp"))
    # ids that stand in one row need no fingerprint to find it again
    odd = cut(rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    some_odd, some_null = bool(odd.take(1)), bool(rows.where(F.col("id").isNull()).take(1))
    plain = kept.where(F.col("id").isNotNull())
    out = docs.join((plain.join(odd, "id", "left_anti") if some_odd else plain).select(F.col("id").alias(id_column)), id_column, "left_semi").select(*docs.columns)
    parts = ([docs.join(odd.select(F.col("id").alias(id_column)), id_column, "left_semi").select(*docs.columns)] if some_odd else []) + ([docs.where(F.col(id_column).isNull())] if some_null else [])
    for part in parts:
        marked = _with_fingerprints(part)
        own = kept.select(F.col("id").alias("__id"), F.col("fp").alias("__kept"))
        held = marked.join(own, marked[id_column].eqNullSafe(own["__id"]) & (marked["__fp"] == own["__kept"]), "left_semi")
        out = out.unionByName(held.dropDuplicates([id_column, "__fp"]).select(*docs.columns))
    return out
