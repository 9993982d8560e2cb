"""Inputs that the catalogue's queries derive from the driver's tables, once for each engine.

``documents`` has no headings, blank lines or links, so Markdown is derived from it: every
fifth line is a level-3 heading, every third other line a level-2 heading, lines are joined
by blank lines, and two links to other documents follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def links_of(doc_id: str = "doc_id"):
    return F.array(*(F.concat(F.lit("Doc "), ((F.col(doc_id) * m + a) % F.lit(200)).cast("string")) for m, a in ((7, 1), (13, 5))))


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, markdown, links)``."""
    line = lambda l, i: F.when((i + 1) % 5 == 0, F.concat(F.lit("### "), l)).when((i + 1) % 3 == 0, F.concat(F.lit("## "), l)).otherwise(l)
    links = links_of()
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    tail = F.array_join(F.transform(links, lambda t: F.concat(F.lit("["), t, F.lit("]("), t, F.lit(")"))), " ")
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.concat(body, F.lit("\n\n"), tail).alias("markdown"), links.alias("links"))


#: The same in DuckDB.
MARKDOWN_SQL = """
md as (
  select doc_id, 'Doc ' || doc_id as title,
    ['Doc ' || ((doc_id * 7 + 1) % 200), 'Doc ' || ((doc_id * 13 + 5) % 200)] as links,
    array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
      case when i % 5 = 0 then '### ' || l when i % 3 = 0 then '## ' || l else l end), chr(10) || chr(10))
    || chr(10) || chr(10)
    || '[Doc ' || ((doc_id * 7 + 1) % 200) || '](Doc ' || ((doc_id * 7 + 1) % 200) || ')'
    || ' [Doc ' || ((doc_id * 13 + 5) % 200) || '](Doc ' || ((doc_id * 13 + 5) % 200) || ')' as markdown
  from documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk of the article that its title names, two documents to an article."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.concat(F.col("doc_id").cast("string"), F.lit("_0")).alias("chunk_id"), "doc_id",
        F.concat(F.lit("Doc "), (F.col("doc_id") % 200).cast("string")).alias("article_title"),
        F.floor(F.col("doc_id") / 200).cast("long").alias("chunk_index"), "text", "lang", "source", links_of().alias("links"),
    )


CHUNKS_SQL = """
chunks as (
  select doc_id || '_0' as chunk_id, doc_id, 'Doc ' || (doc_id % 200) as article_title, doc_id // 200 as chunk_index, text, lang, source,
    ['Doc ' || ((doc_id * 7 + 1) % 200), 'Doc ' || ((doc_id * 13 + 5) % 200)] as links
  from documents)"""
