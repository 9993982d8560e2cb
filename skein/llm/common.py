"""Helpers shared by the training-data operators.

Rules that hold everywhere in this folder:

* a null text is the empty text, a null id stays null in the result;
* words are maximal runs of bytes other than the ASCII white space
  ``\\x20 \\x09-\\x0D`` (``bytes.split()`` splits exactly there);
* columns that an operator doesn't name are ignored, so extra columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from skein.shared import materialise as cut

__all__ = ["cut", "few_ids", "filter_arrow", "held_out", "held_out_column", "labelled_sample", "map_arrow", "one_text", "slices", "table"]

#: Rows whose crc32(doc_id as text) has this remainder are held out of training.
FOLDS, HELD_OUT = 5, 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Apply ``fn`` (columns as lists in, columns as lists out) to every Arrow batch, without a shuffle."""
    arrow = to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def filter_arrow(df: DataFrame, keep: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text (as UTF-8; empty for null) ``keep`` accepts, with all their columns.

    Only the text becomes Python objects; batches are filtered by a mask.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(part.schema.get_field_index(text)).cast(pa.string()).cast(pa.binary()).to_pylist()
                yield part.filter(pa.array(keep([t or b"" for t in texts]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``most`` bytes, so that Python objects of one piece stay small."""
    pieces = max(1, -(-batch.nbytes // most))
    step = max(1, -(-batch.num_rows // pieces))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def held_out(doc_id) -> bool:
    """Whether a row is held out of training: crc32 of its id as text, modulo ``FOLDS``."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def held_out_column(doc_id: str = "doc_id"):
    """The same as a column; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, most: int, seed: int = 17) -> DataFrame:
    """At most ``most`` labelled training rows ``(doc_id, label)``, chosen by a hash of the id.

    Held-out rows never take part.  An id that is labelled twice counts once, with its
    larger label.  The bound makes the result safe to broadcast.
    """
    return (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out_column())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(most)
    )


def few_ids(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct ids (doc_id) of rows that aren't held out, by the smallest hashes.

    Only ids whose hash is below a bar are shuffled, about four times as many as are needed; the bar
    follows from the number of rows, so ids that repeat very often can make the sample smaller.
    """
    hashed = F.xxhash64(F.lit(seed), "doc_id")
    n = max(1, rows.count())
    bar = int(min(1.0, 4 * most / n) * 2**64) - 2**63
    named = rows.select("doc_id").where(F.col("doc_id").isNotNull() & ~held_out_column() & (hashed <= F.lit(min(bar, 2**63 - 1))))
    return named.distinct().orderBy(hashed, "doc_id").limit(most)


def one_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One row ``(doc_id, *columns, text)`` for each id: the text with the smallest hash, where ids repeat.

    It bounds the rows of a sample of ids by the number of ids.  Texts are pre-aggregated in each task.
    """
    return rows.groupBy("doc_id", *columns).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
