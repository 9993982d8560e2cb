"""Queries on whole articles: markup, the chunker, the order of a breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions import wikitext
from skein.operators import chunking, links
from skein.plans.catalogue import _LINES
from skein.plans.derived import MARKDOWN_SQL, markdown, table
from skein.plans.registry import query

#: A page's markup around the columns of a document, and what it must become; {d}, {l}, {s} stand for id, language and source.
_MARKUP = (
    "{{Infobox space town\n| name = [[Doc {d}|{s}]]\n| image = [[File:x.png]]\n| big_size = 4<br>5 '''{l}'''\n| note = {{c|{{d}}}}yes\n}}\n= Top =\n== Text {l} ==\n"
    "'''{l}''' and ''{s}'' {{cite|{{in}}}}[[Doc 1|one]] [[Doc {d}]] [[File:a.png|thumb|[[Doc 7]]]] [[Category:X]]\n=== Deep ===\n* item {s}\n# first\n[http://x.org/{d}  site {s}]\n\n\n\n\nend"
)
_CONTENT = "# Top\n## Text {l}\n**{l}** and *{s}* [one](Doc 2) [{r}]({r})  \n### Deep\n- item {s}\n1. first\n[site {s}](http://x.org/{d})\n\nend"
_BOX = "## Infobox: Space Town\n\n- **Name**: {s}\n- **Big Size**: 4, 5 {l}\n- **Note**: yes"


def _sql_text(template: str, values: dict[str, str]) -> str:
    """A SQL expression for a template's text."""
    out = "'" + template.replace("'", "''") + "'"
    for key, expression in values.items():
        out = f"replace({out}, '{{{key}}}', {expression})"
    return out.replace("\n", "' || chr(10) || '")


def markup(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: each document's wiki page."""
    text = F.lit(_MARKUP)
    for key, column in (("d", F.col("doc_id").cast("string")), ("l", F.col("lang")), ("s", F.col("source"))):
        text = F.replace(text, F.lit("{" + key + "}"), column) if key != "d" else F.replace(F.replace(text, F.lit("Doc {d}"), F.concat(F.lit("Doc "), column)), F.lit("org/{d}"), F.concat(F.lit("org/"), column))
    return docs.select("doc_id", text.alias("text"))


_NAMED = {"d": "doc_id::varchar", "l": "lang", "s": "source", "r": "r"}
#: The pages' content, infobox and links; "Doc 1" is a redirect to "Doc 2".
MARKUP_SQL = f"""
page as (select *, case when doc_id = 1 then 'Doc 2' else 'Doc ' || doc_id end as r from documents),
made as (select doc_id, lang, source, r, {_sql_text(_CONTENT, _NAMED)} as content, {_sql_text(_BOX, _NAMED)} as infobox, r as infobox_links,
  case when doc_id in (1, 7) then 'Doc ' || doc_id || '|Doc ' || (8 - doc_id) else 'Doc ' || doc_id || '|Doc 1|Doc 7' end as wiki_links from page)"""


@query(f"with {MARKUP_SQL} select doc_id, content, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))::integer as word_count, infobox, infobox_links, wiki_links from made")
def wikitext_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates, files and categories go; headings, links with redirects, web links, emphasis, items, infoboxes and their links."""
    made = wikitext.convert_pages(markup(table(spark, sf_dir, "documents")), {"Doc 1": "Doc 2"})
    joined = lambda c: F.array_join(c, "|").alias(c)
    return made.select("doc_id", "content", "word_count", "infobox", joined("infobox_links"), joined("wiki_links"))


@query(f"""
with recursive {MARKDOWN_SQL},
e as (select doc_id as src, unnest(links) as dst_title, generate_subscripts(links, 1) - 1 as pos from md),
g as (select src, m.doc_id as dst, pos from e join md m on m.title = e.dst_title),
r(node, depth, path) as (select 1::bigint, 0, []::bigint[] union all select g.dst, r.depth + 1, list_append(r.path, g.pos) from r join g on g.src = r.node where r.depth < 12),
f as (select node, min(depth) as depth from r group by node),
o as (select r.node, r.depth, min(r.path) as path from r join f on r.node = f.node and r.depth = f.depth group by 1, 2),
p as (select *, row_number() over (order by depth, path) as place from o)
select place::integer as place, node::varchar as id, depth::integer as depth, 'Doc ' || node as title from p where place <= 100""")
def bfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first order over the links of derived articles, with titles.

    A page's place follows from the least path of link positions among its shortest ones, which is how the SQL finds it.
    """
    md = markdown(spark, sf_dir)
    edges = md.select(F.col("doc_id").cast("string").alias("src_id"), F.posexplode("links").alias("pos", "dst_title"))
    titles = md.select("title", F.col("doc_id").cast("string").alias("id"))
    return links.titled(links.breadth_first(edges, titles, "1", 100), titles).select("place", "id", "depth", "title")


def _sentences_sql(text: str) -> str:
    """Sentences of a SQL text: abbreviations, initials and dots of omission are hidden, ends are marked, and all is put back."""
    for i, a in enumerate(T.ABBREVIATIONS):
        text = f"replace({text}, '{a}', chr({57344 + i}))"
    text = rf"regexp_replace(regexp_replace({text}, '([A-Z])\.', '\1' || chr(57360), 'g'), '\.\.\.', chr(57361), 'g')"
    text = rf"""regexp_replace({text}, '([.!?])\s+([A-Z"])', '\1' || chr(57362) || '\2', 'g')"""
    text = f"replace(replace({text}, chr(57360), '.'), chr(57361), '...')"
    for i, a in enumerate(T.ABBREVIATIONS):
        text = f"replace({text}, chr({57344 + i}), '{a}')"
    return f"list_filter(list_transform(string_split({text}, chr(57362)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '')"


#: The chunker in SQL: sections, packing of paragraphs and sentences, and two merges, by walks over numbered rows.
_CHUNK_SQL = rf"""
with recursive {_LINES},
big as (select doc_id, pos, path, list_filter(list_transform(regexp_split_to_array(text, '\n\n+'), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') as parts from sect where length(text) // 4 > 500),
headed as (select doc_id, pos, path, regexp_matches(parts[1], '^#{{2,4}}\s+.+') as h, parts from big),
cleared as (select doc_id, pos, path, case when h then string_split(parts[1], chr(10))[1] || chr(10) || chr(10) else '' end as header,
  list_filter(case when h then list_prepend(trim(substr(parts[1], length(string_split(parts[1], chr(10))[1]) + 2), ' ' || chr(10) || chr(9)), parts[2:]) else parts end, lambda x: x <> '') as parts from headed),
part as (select doc_id, pos, path, header, unnest(parts) as p, generate_subscripts(parts, 1) as i from cleared),
split as (select doc_id, pos, path, header, i, length(p) // 4 > 500 as large, case when length(p) // 4 > 500 then {_sentences_sql('p')} else [p] end as pieces from part),
piece as (select doc_id, pos, path, header, i, large, unnest(pieces) as piece, generate_subscripts(pieces, 1) as j from split),
item as (select *, row_number() over (partition by doc_id, pos order by i, j) as k, length(piece) // 4 as n, large and j = 1 as forced, case when large then ' ' else chr(10) || chr(10) end as glue from piece),
pack as (select doc_id, pos, k, n as used, 0 as g from item where k = 1
  union all select z.doc_id, z.pos, z.k, case when z.forced or w.used + z.n > 500 then z.n else w.used + z.n end, w.g + case when z.forced or w.used + z.n > 500 then 1 else 0 end
  from pack w join item z on z.doc_id = w.doc_id and z.pos = w.pos and z.k = w.k + 1),
grouped as (select i.*, p.g, lead(p.g) over (partition by i.doc_id, i.pos order by i.k) as g_next, lead(i.forced) over (partition by i.doc_id, i.pos order by i.k) as f_next, lead(i.glue) over (partition by i.doc_id, i.pos order by i.k) as glue_next
  from item i join pack p on p.doc_id = i.doc_id and p.pos = i.pos and p.k = i.k),
glued as (select *, last_value(case when g_next is null or g_next = g then null when f_next then chr(10) || chr(10) else glue_next end ignore nulls) over (partition by doc_id, pos, g order by k rows between unbounded preceding and unbounded following) as joint from grouped),
body as (select doc_id, pos, g, any_value(path) as path, any_value(header) as header, list(piece order by k) as pieces, coalesce(any_value(joint), chr(10) || chr(10)) as joint from glued group by doc_id, pos, g),
packed as (select doc_id, pos, g, path, header || list_reduce(pieces, lambda a, b: a || joint || b) as text, count(*) over (partition by doc_id, pos) as total from body),
small as (select doc_id, pos, g, path, total, text as whole, length(text) // 4 < 50 and g < total - 1 as little from packed where g = 0
  union all select z.doc_id, z.pos, z.g, z.path, z.total, case when w.little then w.whole || chr(10) || chr(10) || z.text else z.text end,
    length(case when w.little then w.whole || chr(10) || chr(10) || z.text else z.text end) // 4 < 50 and z.g < z.total - 1 from small w join packed z on z.doc_id = w.doc_id and z.pos = w.pos and z.g = w.g + 1),
flat as (select doc_id, pos, g, path, whole as text from small where not little union all select doc_id, pos, 0, path, text from sect where length(text) // 4 <= 500),
numbered as (select *, row_number() over (partition by doc_id order by pos, g) - 1 as i, count(*) over (partition by doc_id) as total from flat),
last as (select doc_id, i, path, total, text as whole, length(text) // 4 < 10 and i < total - 1 as little from numbered where i = 0
  union all select z.doc_id, z.i, z.path, z.total, case when w.little then w.whole || chr(10) || chr(10) || z.text else z.text end,
    length(case when w.little then w.whole || chr(10) || chr(10) || z.text else z.text end) // 4 < 10 and z.i < z.total - 1 from last w join numbered z on z.doc_id = w.doc_id and z.i = w.i + 1),
placed as (select doc_id, path, whole as text, row_number() over (partition by doc_id order by i) - 1 as chunk_index from last where not little)
select doc_id || '_' || chunk_index as chunk_id, doc_id::varchar as wiki_page_id, 'Doc ' || doc_id as article_title, path as section_path, chunk_index::integer as chunk_index, text as chunk_text,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '\[([^\]]+)\]\(([^()]*(?:\([^()]*\)[^()]*)*)\)', 2), lambda x: not regexp_matches(x, '^(https?://|#)')))), '|') as links from placed"""


@query(_CHUNK_SQL)
def chunk_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chunker on derived articles."""
    md = markdown(spark, sf_dir).select(F.col("doc_id").cast("string").alias("wiki_id"), "title", F.col("markdown").alias("content"))
    return chunking.chunk(md).drop("article_last_updated").withColumn("links", F.array_join(F.array_sort("links"), "|"))


@query(f"with {MARKUP_SQL} select doc_id || '_0' as chunk_id, 'Infobox' as section_path, 0::integer as chunk_index, infobox as chunk_text, infobox_links as links from made")
def infobox_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's infobox is its first chunk, with the infobox's links."""
    made = wikitext.convert_pages(markup(table(spark, sf_dir, "documents")), {"Doc 1": "Doc 2"})
    pages = made.select(F.col("doc_id").cast("string").alias("wiki_id"), F.lit("T").alias("title"), "content", "infobox", "infobox_links")
    return chunking.chunk(pages).where("section_path = 'Infobox'").select("chunk_id", "section_path", "chunk_index", "chunk_text", F.array_join("links", "|").alias("links"))
