"""Wiki XML exports: pages, redirects, titles, articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import wikitext

#: Read by Spark's XML source; element order, attributes and the namespace don't matter.
PAGE = "title string, ns string, id string, redirect struct<_title: string>, revision struct<timestamp: string, text struct<_VALUE: string>>"


def pages(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Raw pages of an export, read in parallel splits; ``strict`` fails on malformed ones."""
    return spark.read.format("xml").option("rowTag", "page").option("mode", "FAILFAST" if strict else "PERMISSIVE").schema(PAGE).load(path)


def _unescape(text):
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def redirects(raw: DataFrame) -> DataFrame:
    """``(source, target)``: main-namespace redirects; of repeated sources the last page (by number) wins."""
    found = raw.where((F.trim("ns") == "0") & F.col("redirect").isNotNull()).select(F.trim("title").alias("source"), _unescape(F.col("redirect._title")).alias("target"), F.col("id").cast("long").alias("n"))
    found = found.where((F.col("source") != "") & (F.col("target") != ""))
    return found.groupBy("source").agg(F.max_by("target", "n").alias("target"))


def titles(raw: DataFrame) -> DataFrame:
    """``(title, id)`` of main-namespace pages, redirects included, under both ``a b`` and ``a_b``; the last page wins."""
    named = raw.where((F.trim("ns") == "0") & F.col("title").isNotNull() & F.col("id").isNotNull()).select(F.trim("title").alias("t"), F.trim("id").alias("id"))
    each = named.select(F.explode(F.array_distinct(F.array("t", F.replace("t", F.lit(" "), F.lit("_"))))).alias("title"), "id")
    return each.groupBy("title").agg(F.max_by("id", F.col("id").cast("long")).alias("id"))


def article_pages(raw: DataFrame, page_ids: DataFrame | list[str] | None = None) -> DataFrame:
    """``(wiki_id, title, last_updated, text)`` of main-namespace pages that aren't redirects and have a text.

    The page filter comes before any conversion.  ``page_ids`` is a short list or a table (id);
    an empty list is no filter.
    """
    sound = raw.where((F.trim("ns") == "0") & F.col("redirect").isNull() & (F.trim("id") != "") & (F.trim("title") != "") & F.col("revision.text._VALUE").isNotNull())
    out = sound.select(F.trim("id").alias("wiki_id"), F.trim("title").alias("title"), F.coalesce("revision.timestamp", F.lit("")).alias("last_updated"), F.col("revision.text._VALUE").alias("text"))
    if isinstance(page_ids, list):
        return out.where(F.col("wiki_id").isin(page_ids)) if page_ids else out
    return out.join(page_ids.select(F.col("id").cast("string").alias("wiki_id")), "wiki_id", "left_semi") if page_ids is not None else out


def articles(spark: SparkSession, path: str, page_ids: DataFrame | list[str] | None = None) -> DataFrame:
    """Converted articles: (wiki_id, title, last_updated, content, word_count, infobox, infobox_links).

    A join gives each page the redirects that it looks up (``wikitext.with_redirects``), for tables of any size.
    """
    raw = pages(spark, path)
    made = wikitext.convert_pages(wikitext.with_redirects(article_pages(raw, page_ids), redirects(raw)), raw=False)
    return made.where((F.trim("content") != "") & (F.col("word_count") >= 0))


def edges(raw: DataFrame) -> DataFrame:
    """``(src_id, dst_title, pos)``: links of all main-namespace pages in order; one scan."""
    from skein.functions.text import wiki_links

    linked = raw.where((F.trim("ns") == "0") & F.col("revision.text._VALUE").isNotNull()).select(F.trim("id").alias("src_id"), wiki_links(F.col("revision.text._VALUE")).alias("links"))
    return linked.select("src_id", F.posexplode("links").alias("pos", "dst_title"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
