"""Queries over real files in the shared folder: exports, archives, JSON files, id lists, stores, keyword indexes.

Each writes the driver's documents in the form that an operator reads, and reads them back by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import shared
from skein.operators import embed, ingest, keyword, links, metadata, quality
from skein.operators.store import ChunkStore
from skein.plans.articles import MARKUP_SQL, markup
from skein.plans.catalogue import _BM25, _searched
from skein.plans.derived import table
from skein.plans.registry import query
from skein.sources import archive, wiki

# --- wiki exports -------------------------------------------------------------------------

#: Of the documents, every seventh is in another namespace, every fifth of the others a redirect, and every eleventh of the rest has no text.
_PAGES_SQL = """
p as (select doc_id, 'Doc ' || doc_id as title, case when doc_id % 7 = 0 then '1' else '0' end as ns, doc_id % 5 = 1 as is_redirect, 'Doc ' || (doc_id * 3 % 200) || ' & Co' as target,
  case when doc_id % 3 <> 0 then '2024-01-0' || (doc_id % 9 + 1) || 'T00:00:00Z' end as stamp, doc_id % 11 = 2 as blank from documents)"""


def export(spark: SparkSession, sf_dir: str) -> str:
    """An XML export of the documents' wiki pages, in the shared folder; its path."""
    d = F.col("doc_id")
    n = d.cast("string")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    target = F.concat(F.lit('<redirect title="Doc '), (d * 3 % 200).cast("string"), F.lit(' &amp; Co" />'))
    stamp = F.when(d % 3 != 0, F.concat(F.lit("<timestamp>2024-01-0"), (d % 9 + 1).cast("string"), F.lit("T00:00:00Z</timestamp>"))).otherwise("")
    text = F.when(d % 11 == 2, "").otherwise(F.concat(F.lit('<text bytes="2" xml:space="preserve">'), escaped(F.col("text")), F.lit("</text>")))
    xml = F.concat(
        F.lit("<page><title>Doc "), n, F.lit("</title><ns>"), F.when(d % 7 == 0, "1").otherwise("0"), F.lit("</ns><id>"), n, F.lit("</id>"),
        F.when(d % 5 == 1, target).otherwise(""), F.lit("<revision>"), stamp, text, F.lit("</revision></page>"),
    )
    path = shared.scratch(spark, "export")

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda value: pa.RecordBatch.from_pydict({"value": [value]})
        yield line("<mediawiki>")
        yield from batches
        yield line("</mediawiki>")

    markup(table(spark, sf_dir, "documents")).select(xml.alias("value")).mapInArrow(wrapped, "value string").write.text(path)
    return path


@query(f"with {_PAGES_SQL} select title, ns, doc_id::varchar as id, case when is_redirect then target end as redirect, coalesce(stamp, '') as stamp, not blank as has_text from p")
def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = wiki.pages(spark, export(spark, sf_dir))
    return raw.select("title", "ns", "id", F.col("redirect._title").alias("redirect"), F.coalesce("revision.timestamp", F.lit("")).alias("stamp"), F.col("revision.text._VALUE").isNotNull().alias("has_text"))


@query(f"with {_PAGES_SQL} select title as source, target from p where ns = '0' and is_redirect")
def xml_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.redirects(wiki.pages(spark, export(spark, sf_dir)))


@query(f"with {_PAGES_SQL} select unnest([title, replace(title, ' ', '_')]) as title, doc_id::varchar as id from p where ns = '0'")
def xml_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.titles(wiki.pages(spark, export(spark, sf_dir)))


@query(f"""
with {_PAGES_SQL}, l as (select p.doc_id, string_split(case when p.doc_id in (1, 7) then 'Doc ' || p.doc_id || '|Doc ' || (8 - p.doc_id) else 'Doc ' || p.doc_id || '|Doc 1|Doc 7' end, '|') as l from p where ns = '0' and not blank)
select doc_id::varchar as src_id, unnest(l) as dst_title, (generate_subscripts(l, 1) - 1)::integer as pos from l""")
def xml_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wiki.edges(wiki.pages(spark, export(spark, sf_dir)))


@query(f"""
with {_PAGES_SQL}, {MARKUP_SQL.replace("case when doc_id = 1 then 'Doc 2' else 'Doc ' || doc_id end as r", "case when doc_id % 7 <> 0 and doc_id % 5 = 1 then 'Doc ' || (doc_id * 3 % 200) || ' & Co' else 'Doc ' || doc_id end as r")}
select m.doc_id::varchar as wiki_id, p.title, coalesce(p.stamp, '') as last_updated, replace(m.content, '[one](Doc 2)', '[one](Doc 3 & Co)') as content, m.infobox, m.infobox_links
from made m join p on p.doc_id = m.doc_id where p.ns = '0' and not p.is_redirect and not p.blank""")
def xml_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export's articles, with the links of content and infobox resolved by the export's own redirects."""
    made = wiki.articles(spark, export(spark, sf_dir))
    return made.select("wiki_id", "title", "last_updated", "content", "infobox", F.array_join("infobox_links", "|").alias("infobox_links"))


@query(f"with {_PAGES_SQL} select doc_id::varchar as wiki_id from p where ns = '0' and not is_redirect and not blank and doc_id % 2 = 0")
def xml_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the pages in an id file."""
    path = shared.scratch(spark, "ids")
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise("# none").alias("value")).write.text(path)
    return wiki.article_pages(wiki.pages(spark, export(spark, sf_dir)), archive.id_table(spark, path)).select("wiki_id")


@query("select true as valid, 0::integer as issues, 0::integer as warnings")
def validate_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page by number has a title and a text."""
    return quality.check_xml(wiki.pages(spark, export(spark, sf_dir))).select("valid", F.size("issues").alias("issues"), F.size("warnings").alias("warnings"))


# --- Markdown archives --------------------------------------------------------------------

_ARCHIVE_SQL = """
a as (select doc_id, 'It''s-' || doc_id || '.md' as name, trim(text, ' ' || chr(10) || chr(9) || chr(13)) as body, case when doc_id % 10 = 3 then 'no front matter' when doc_id % 10 = 4 then 'no wiki_id' end as reason, lang, n_chars from documents)"""


def _archive(spark: SparkSession, sf_dir: str) -> str:
    """An archive of the documents, some of them spoilt; its path."""
    path = shared.scratch(spark, "archive")
    docs = table(spark, sf_dir, "documents")
    n = F.col("doc_id").cast("string")
    good = docs.select(F.when(F.col("doc_id") % 10 != 4, n).otherwise("").alias("wiki_id"), F.concat(F.lit("It's-"), n).alias("title"), F.col("lang").alias("last_updated"), F.col("text").alias("content"), F.col("n_chars").cast("int").alias("word_count"), "doc_id")
    archive.write(good.where("doc_id % 10 <> 3"), path)
    archive.write_files(docs.where("doc_id % 10 = 3").select(F.concat(F.lit("Its-"), n, F.lit(".md")).alias("name"), F.col("lang").alias("raw")), path)
    return path


@query(f"with {_ARCHIVE_SQL} select row_number() over (order by 'Its-' || doc_id || '.md')::integer as place, doc_id::varchar as wiki_id, 'It''s-' || doc_id as title, lang as last_updated, body as content, n_chars::integer as word_count from a where reason is null")
def archive_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written one file an article and read again in the order of their names; spoilt files are left out."""
    rows = archive.load(spark, _archive(spark, sf_dir), in_order=True)
    named = rows.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return ingest.batches(named, "name", 1).select(F.col("batch").alias("place"), "wiki_id", "title", "last_updated", "content", "word_count")


@query(f"with {_ARCHIVE_SQL} select count(*) as n_files, count(*) filter (reason is null) as n_loaded, count(*) filter (reason is not null) as n_skipped from a")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.counts(spark, _archive(spark, sf_dir))


@query(f"with {_ARCHIVE_SQL} select 'Its-' || doc_id || '.md' as name, reason from a where reason is not null")
def archive_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive.rejected(archive.files(spark, _archive(spark, sf_dir)))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "reason")


@query(f"with {_ARCHIVE_SQL} select doc_id::varchar as wiki_id from a where reason is null and doc_id <= 90")
def archive_wiki_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an archive's articles that an id file lists; the file is written as the test bed's is."""
    path = shared.scratch(spark, "ids")
    wanted = table(spark, sf_dir, "documents").where("doc_id <= 90").select(F.col("doc_id").alias("place"), F.col("doc_id").cast("string").alias("id"), F.lit("T").alias("title"))
    archive.write_id_list(wanted, path, "1")
    return archive.load(spark, _archive(spark, sf_dir), archive.id_table(spark, path)).select("wiki_id")


# --- JSON files ---------------------------------------------------------------------------

_CHUNK = "id string, wiki_page_id string, article_title string, section_path string, chunk_text string, chunk_index int, article_last_updated string, links array<string>, embedding array<float>"


def _chunk_rows(spark: SparkSession, sf_dir: str, version: str = "v1") -> DataFrame:
    """Each document as a chunk with a vector; four documents to an article."""
    d = F.col("doc_id")
    page = F.floor(d / 4).cast("string")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(page, F.lit("_"), (d % 4).cast("string")).alias("id"), page.alias("wiki_page_id"), F.concat(F.lit("A"), page).alias("article_title"), F.col("source").alias("section_path"), F.col("text").alias("chunk_text"),
        (d % 4).cast("int").alias("chunk_index"), F.lit(version).alias("article_last_updated"), F.when(d % 2 == 0, F.array(F.concat(F.lit("A"), page))).otherwise(F.array().cast("array<string>")).alias("links"),
        F.array((d % 3).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
    )
    return rows


_CHUNK_ROWS = "c as (select doc_id, (doc_id // 4)::varchar as page, (doc_id // 4) || '_' || (doc_id % 4) as id, (doc_id % 4)::integer as chunk_index, text, source, case when doc_id % 2 = 0 then 'A' || (doc_id // 4) else '' end as links from documents)"


@query(f"with {_CHUNK_ROWS} select 'A' || page as article_title, source as section_path, chunk_index, text as chunk_text from c")
def json_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.scratch(spark, "json")
    rows = _chunk_rows(spark, sf_dir).select("chunk_text", "article_title", "section_path", "chunk_index")
    archive.write_wrapped(rows, path, "chunks", version="1.0", total_articles=3)
    return archive.read_chunks(spark, path).select("article_title", "section_path", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk_text")


@query(f"with {_CHUNK_ROWS} select id as chunk_id, source as section_path, (doc_id % 3)::double as first, 2::integer as dimensions from c")
def json_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without vectors meet the vectors of a JSON file by their ids."""
    path = shared.scratch(spark, "json")
    rows = _chunk_rows(spark, sf_dir).withColumnRenamed("id", "chunk_id")
    archive.write_wrapped(rows.select("chunk_id", "embedding"), path, "embeddings", model="hash", dimensions=2)
    met = rows.select("chunk_id", "section_path").join(archive.read_embeddings(spark, path), "chunk_id")
    return met.select("chunk_id", "section_path", F.col("embedding")[0].cast("double").alias("first"), F.size("embedding").alias("dimensions"))


# --- stores -------------------------------------------------------------------------------


def _store(spark: SparkSession, sf_dir: str) -> ChunkStore:
    store = ChunkStore(spark, shared.scratch(spark, "store"), 16)
    store.add(_chunk_rows(spark, sf_dir))
    return store


@query(f"with {_CHUNK_ROWS} select id, page as wiki_page_id, 'A' || page as article_title, source as section_path, text as chunk_text, chunk_index, 'v1' as article_last_updated, links, (doc_id % 3)::double as first from c")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _store(spark, sf_dir).rows()
    return rows.select("id", "wiki_page_id", "article_title", "section_path", "chunk_text", "chunk_index", "article_last_updated", F.array_join("links", "|").alias("links"), F.col("embedding")[0].cast("double").alias("first"))


@query(f"with {_CHUNK_ROWS} select id, case when page::integer % 3 = 1 then 'v2' else 'v1' end as article_last_updated from c where page::integer % 3 <> 0 and id <> '2_1'")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles deleted, articles replaced by a new version, and one chunk deleted."""
    store = _store(spark, sf_dir)
    rows = _chunk_rows(spark, sf_dir, "v2")
    kind = F.col("wiki_page_id").cast("int") % 3
    store.delete_articles(rows.where(kind == 0).select("wiki_page_id"))
    store.replace_articles(rows.where(kind == 1))
    store.delete_chunk("2_1")
    return store.rows().select("id", "article_last_updated")


@query(f"with {_CHUNK_ROWS} select page as wiki_page_id, case when page::integer % 2 = 0 then 'v2' else 'v1' end as stored from c group by page")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.replace_articles(_chunk_rows(spark, sf_dir, "v2").where(F.col("wiki_page_id").cast("int") % 2 == 0))
    return store.versions()


@query(f"with {_CHUNK_ROWS} select id, text as chunk_text, links from c where id = '3_2'")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).get("3_2").select("id", "chunk_text", F.array_join("links", "|").alias("links"))


@query(f"with {_CHUNK_ROWS} select id, chunk_index from c where source = 'src3' and chunk_index = 1")
def store_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).find({"section_path": "src3", "chunk_index": 1}).select("id", "chunk_index")


@query("select count(*) as before, 'healthy' as status, count(*) as purged, 0::bigint as after, true as dropped from documents")
def store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, health, purge, and a store that is opened again after it was dropped."""
    store = _store(spark, sf_dir)
    health, purged = store.health(), store.purge()
    after = store.count()
    store.drop()
    dropped = not shared.exists(spark, store.path) and ChunkStore(spark, store.path).count() == 0
    return spark.createDataFrame([(health["count"], health["status"], purged, after, dropped)], "before long, status string, purged long, after long, dropped boolean")


@query("select (select count(*) from documents) as n_add, (select count(*) from documents) // 2 as n_skip, 0::bigint as failed, (select count(*) from documents) as n_stored")
def ingest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, each given twice in one run, into a store; then half of them again, unchanged."""
    store = ChunkStore(spark, shared.scratch(spark, "store"), 16)
    n = F.col("doc_id").cast("string")
    short = table(spark, sf_dir, "documents").select(n.alias("wiki_id"), F.concat(F.lit("Doc "), n).alias("title"), F.col("lang").alias("last_updated"), F.col("source").alias("content"))
    vectors = lambda c: embed.embed(c, embed.hashing(4))
    index = shared.scratch(spark, "index")
    first = ingest.ingest(short.unionByName(short.withColumn("last_updated", F.lit("again"))), store, vectors, metadata.extract, index)
    again = ingest.ingest(short.limit(short.count() // 2), store, vectors, metadata.extract)
    kept = store.rows().where("article_last_updated <> 'again'").count()
    return spark.createDataFrame([(first["add"], again["skip"], first["failed"], kept)], "n_add long, n_skip long, failed long, n_stored long")


# --- keyword indexes ----------------------------------------------------------------------


@query(f"with {_BM25}, {_searched('select item_id as query_id, text from benchmark', 5)} select query_id, doc_id as chunk_id, score, rank::integer as rank from kw")
def bm25_saved_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index saved over an older one of fewer chunks, loaded, and searched."""
    path, docs = shared.scratch(spark, "index"), table(spark, sf_dir, "documents")
    keyword.build(docs.limit(10), "doc_id", "text").save(path)
    keyword.build(docs, "doc_id", "text", path=path)
    return keyword.search(keyword.load(spark, path), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)


@query("select doc_id::varchar as id, case when doc_id % 3 = 0 then 'Unknown' else 'Doc ' || doc_id end as title from documents")
def titles_of_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of ids, "Unknown" where there is none."""
    n = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents")
    return links.titled(docs.select(n.alias("id")), docs.where("doc_id % 3 <> 0").select(n.alias("id"), F.concat(F.lit("Doc "), n).alias("title")))
