"""Metadata of chunks: frequent names, source books, version, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.session import ValidationError


def extract(chunks: DataFrame, text: str = "chunk_text", check: bool = False) -> DataFrame:
    """``chunks`` with character_names and source_books; ``check`` makes a blank text an error."""
    if check and chunks.where(F.coalesce(text, F.lit("")) == "").take(1):
        raise ValidationError("a chunk has no text")
    body = F.col(text)
    return chunks.withColumns({"character_names": T.character_names(body), "source_books": T.source_books(body)})


def as_struct(chunks: DataFrame) -> DataFrame:
    """``chunks`` with one ``metadata`` column; links are null where there are none."""
    links = F.when(F.size("links") > 0, F.col("links"))
    return chunks.withColumn("metadata", F.struct("character_names", "source_books", "article_last_updated", links.alias("links")))
