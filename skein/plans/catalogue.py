"""All registered queries by name, and the SQL that gives the same rows.

A query applies an operator to the driver's tables, whole.  Where DuckDB can express it, its
SQL stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import answers, wikitext
from skein.functions import text as T
from skein.operators import analytics, chunking, expand, hybrid, ingest, keyword, links, metadata, quality, vector
from skein.plans.derived import CHUNKS_SQL, MARKDOWN_SQL, chunks, markdown, table
from skein.plans.registry import ORACLE_SQL, QUERIES, query
from skein.session import ExpansionConfig, HybridConfig

# --- keyword search -----------------------------------------------------------------------

#: Text of the single keyword query; its terms are frequent and rare ones of the tables.
QUESTION = "the and erin blees onen the"
_BM25 = """
tok as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as term from documents),
dl as (select d.doc_id, coalesce(n, 0) as dl from documents d left join (select doc_id, count(*) as n from tok group by 1) t using (doc_id)),
st as (select count(*) as n_docs, avg(dl) as avgdl, sum(dl)::bigint as n_tokens from dl),
tf as (select term, doc_id, count(*) as tf from tok group by all),
rawidf as (select term, count(*) as df, ln((select n_docs from st) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) as raw from tf group by 1),
idf as (select term, df, case when raw >= 0 then raw else 0.25e0 * (select avg(raw) from rawidf) end as idf from rawidf)"""


def _searched(queries: str, k: int) -> str:
    return f"""
q as ({queries}),
qt as (select query_id, term, count(*) as times from (select query_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as term from q) group by all),
sc as (select query_id, doc_id, round(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / (select avgdl from st)))), 6) as score
  from qt join idf using (term) join tf using (term) join dl using (doc_id) group by all),
every as (select query_id, doc_id, coalesce(score, 0) as score from (select distinct query_id from q) cross join documents left join sc using (query_id, doc_id)),
kw as (select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from every) where rank <= {k})"""


def _index(spark: SparkSession, sf_dir: str) -> keyword.KeywordIndex:
    """The index of ``documents``, built once and kept in the shared folder."""
    return keyword.stored(table(spark, sf_dir, "documents"), "documents", "doc_id", "text")


def _question(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, text string")


@query(f"with {_BM25}, {_searched(f'select 0::bigint as query_id, {QUESTION!r} as text', 20)} select query_id, doc_id as chunk_id, score, rank::integer as rank from kw")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.search(_index(spark, sf_dir), _question(spark), 20)


@query(f"with {_BM25}, {_searched('select item_id as query_id, text from benchmark', 10)} select query_id, doc_id as chunk_id, score, rank::integer as rank from kw")
def bm25_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.search(_index(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)


@query(f"with {_BM25} select term, df, round(idf, 6) as idf from idf")
def bm25_index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select n_docs, n_tokens, (select count(*) from idf) as n_terms, round(avgdl, 6) as avgdl from st")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword.stats(_index(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


# --- vector search ------------------------------------------------------------------------

_DISTANCE = "round(1 - list_inner_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_inner_product(a.embedding::double[], a.embedding::double[])) * sqrt(list_inner_product(b.embedding::double[], b.embedding::double[]))), 6) + 0.0e0"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_of(spark: SparkSession, sf_dir: str, *ids: int) -> dict[int, list[float]]:
    rows = _vectors(spark, sf_dir).where(F.col("chunk_id").isin(list(ids))).select("chunk_id", "embedding").collect()
    return {r[0]: list(r[1]) for r in rows}


def _nearest(k: int, where: str = "true", queries: str = "a.vec_id = 0") -> str:
    return f"""near as (select query_id, vec_id, distance, rank from (
  select a.vec_id as query_id, b.vec_id, {_DISTANCE} as distance, row_number() over (partition by a.vec_id order by {_DISTANCE}, b.vec_id) as rank
  from embeddings a join embeddings b on {queries} where {where}) where rank <= {k})"""


@query(f"with {_nearest(10)} select vec_id as chunk_id, distance, rank::integer as rank from near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0)[0], 10)


@query(f"with {_nearest(10, 'b.label = 3')} select vec_id as chunk_id, distance, rank::integer as rank from near")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector.search(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0)[0], 10, {"label": 3})


@query(f"with {_nearest(5, queries='a.vec_id % 50 = 0')} select query_id, vec_id as chunk_id, distance, rank::integer as rank from near")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vector.search_table(rows, rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector")), 5)


# --- hybrid retrieval and expansion -------------------------------------------------------


def _fused(v: float, b: float, k: int) -> str:
    return f"""fused as (select * from (select *, row_number() over (partition by query_id order by score desc, v_rank asc nulls last, b_rank asc nulls last) as rank from (
  select coalesce(n.query_id, kw.query_id) as query_id, coalesce(n.vec_id, kw.doc_id) as doc_id, n.rank as v_rank, kw.rank as b_rank,
    round(coalesce({v}e0 / (60 + n.rank), 0) + coalesce({b}e0 / (60 + kw.rank), 0), 9) as score
  from near n full join kw on n.query_id = kw.query_id and n.vec_id = kw.doc_id)) where rank <= {k})"""


_HYBRID = f"with {_BM25}, {_searched(f'select 0::bigint as query_id, {QUESTION!r} as text', 20)}, {_nearest(20)}, "


def _hits(spark: SparkSession, sf_dir: str, config: HybridConfig = HybridConfig(), k: int | None = None) -> DataFrame:
    return hybrid.retrieve(_index(spark, sf_dir), _vectors(spark, sf_dir), _question(spark), _vector_of(spark, sf_dir, 0), config, k)


@query(_HYBRID + _fused(0.5, 0.5, 20) + " select query_id, doc_id as chunk_id, score, rank::integer as rank, text, source from fused join documents using (doc_id)")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    return hybrid.with_rows(_hits(spark, sf_dir), docs)


@query(f"with {_BM25}, {_searched(f'select 0::bigint as query_id, {QUESTION!r} as text', 10)}, {_nearest(10)}, " + _fused(0.7, 0.3, 10) + " select query_id, doc_id as chunk_id, score, rank::integer as rank from fused")
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, HybridConfig(vector_weight=0.7, keyword_weight=0.3), 10)


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d join labels l using (doc_id) where lang = 'en' and quality = 1 and toxic = 0")
def metadata_filter_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = vector.where_equal(table(spark, sf_dir, "documents"), {"lang": "en"})
    kept = vector.where_equal(table(spark, sf_dir, "labels"), {"quality": 1, "toxic": 0})
    return docs.join(kept, "doc_id").select("doc_id", "source", "quality", "toxic")


def _expanded_sql(depth: int, most: int) -> str:
    one = f"""
hits as (select 'q' as query_id, f.rank as rank, f.score, c.* from fused f join chunks c on f.doc_id = c.doc_id),
l1 as (select link, row_number() over (order by k) as link_pos from (select link, min(rank * 1000 + p) as k from (
  select rank, unnest(links) as link, generate_subscripts(links, 1) as p from hits) group by link)),
ranked as (select *, row_number() over (partition by article_title order by chunk_index, chunk_id) as n from chunks),
c1 as (select chunk_id, min(link_pos * 1000 + n) as k, any_value(r.links) as links from l1 join ranked r on r.article_title = l1.link and r.n <= 2
  where link_pos <= {most} and chunk_id not in (select chunk_id from hits) group by chunk_id),
e1 as (select * from (select *, row_number() over (order by k) as pos from c1) where pos <= {most} - (select count(*) from hits))"""
    two = """
l2 as (select link, row_number() over (order by k) as link_pos from (select link, min(rank * 1000 + p) as k from (
  select pos as rank, unnest(links) as link, generate_subscripts(links, 1) as p from e1) group by link)),
c2 as (select chunk_id, min(link_pos * 1000 + n) as k from l2 join ranked r on r.article_title = l2.link and r.n <= 1
  where chunk_id not in (select chunk_id from hits) and chunk_id not in (select chunk_id from e1) group by chunk_id),
e2 as (select *, row_number() over (order by k) as pos from c2)"""
    rows = "select chunk_id, score, 0 as depth, rank as pos from hits union all select chunk_id, 0, 1, pos from e1"
    if depth == 2:
        rows += " union all select chunk_id, 0, 2, pos from e2"
    return f"{_HYBRID}{_fused(0.5, 0.5, 20)}, {CHUNKS_SQL}, {one}{', ' + two if depth == 2 else ''}, placed as (select *, row_number() over (order by depth, pos) as place from ({rows})) select 0::bigint as query_id, chunk_id, score::double as score, place::integer as place, depth::integer as depth from placed where place <= {most}"


def _expanded(spark: SparkSession, sf_dir: str, config: ExpansionConfig) -> DataFrame:
    hits = _hits(spark, sf_dir).withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit("_0")))
    return expand.expand(hits, chunks(spark, sf_dir).select("chunk_id", "article_title", "chunk_index", "links"), config)


@query(_expanded_sql(1, 30))
def context_expand_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, ExpansionConfig(1, 30))


@query(_expanded_sql(2, 80))
def context_expand_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expanded(spark, sf_dir, ExpansionConfig(2, 80))


# --- links and graphs ---------------------------------------------------------------------


@query("""
with r as (select 'Doc ' || (p_partkey * 2) as source, 'Doc ' || (p_partkey * 3 % 500) as target from part),
l as (select doc_id, 'Doc ' || ((doc_id * 7 + 1) % 200) as link from documents)
select doc_id, coalesce(target, link) as link from l left join r on link = source""")
def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    redirects = part.select(F.concat(F.lit("Doc "), (F.col("p_partkey") * 2).cast("string")).alias("source"), F.concat(F.lit("Doc "), (F.col("p_partkey") * 3 % 500).cast("string")).alias("target"))
    linked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), ((F.col("doc_id") * 7 + 1) % 200).cast("string")).alias("link"))
    return links.resolve(linked, redirects)


@query(f"with {MARKDOWN_SQL}, f as (select doc_id, list_distinct(regexp_extract_all(markdown, '\\[([^\\]]+)\\]\\(([^()]*(?:\\([^()]*\\)[^()]*)*)\\)', 2)) as l from md) select doc_id, unnest(l) as link from f")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("doc_id", F.explode(T.links(F.col("markdown"))).alias("link"))


_HREF = """hrefs as (select page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) as l from pages),
e as (select page_id, unnest(l) as dst_title, generate_subscripts(l, 1) - 1 as pos from hrefs)"""


def _page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1)).alias("l"))
    return found.select("page_id", F.posexplode("l").alias("pos", "dst_title"))


@query(f"with {_HREF} select page_id, dst_title, pos::integer as pos from e")
def page_links_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_edges(spark, sf_dir)


@query(f"with {_HREF} select dst_title as title, count(*) as n from e group by 1 order by n desc, title limit 10")
def incoming_link_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.incoming(_page_edges(spark, sf_dir))


@query("""
with recursive e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem union select distinct 'p' || l_partkey, 's' || l_suppkey from lineitem),
r(node, depth) as (select 's1', 0 union select e.dst, r.depth + 1 from r join e on e.src = r.node where r.depth < 2)
select node, min(depth)::integer as depth from r group by node""")
def bfs_test_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p")).distinct()
    both = l.select(F.col("s").alias("src"), F.col("p").alias("dst")).unionByName(l.select(F.col("p").alias("src"), F.col("s").alias("dst")))
    return links.levels(both, "s1", 2)


# --- text and chunks ----------------------------------------------------------------------

_LINES = f"""{MARKDOWN_SQL},
li as (select doc_id, title, unnest(string_split(markdown, chr(10))) as line, generate_subscripts(string_split(markdown, chr(10)), 1) as i from md),
hd as (select *, case when regexp_matches(line, '^#{{2,4}}\\s+.+$') then length(regexp_extract(line, '^(#{{2,4}})', 1)) end as level,
  trim(regexp_extract(line, '^#{{2,4}}\\s+(.+)$', 1)) as name from li),
sn as (select *, count(level) over (partition by doc_id order by i) as s, last_value(case when level = 2 then name end ignore nulls) over (partition by doc_id order by i) as parent from hd),
se as (select doc_id, title, s, trim(string_agg(line, chr(10) order by i), ' ' || chr(10) || chr(9)) as text, max(level) as level, any_value(name) filter (level is not null) as name,
  any_value(parent) filter (level is not null) as parent from sn group by all),
sections as (select doc_id, s, text, case when level is null then 'Root' when level = 2 or parent is null then name else parent || ' > ' || name end as path, coalesce(level, 0) as level,
  count(*) filter (level is not null) over (partition by doc_id) as n_heads, title from se where text <> ''),
sect as (select doc_id, row_number() over (partition by doc_id order by s) - 1 as pos, text, path, level from sections where n_heads > 0
  union all select doc_id, 0, markdown, title, 1 from md where doc_id not in (select doc_id from sections where n_heads > 0))"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections(F.col("markdown"), F.col("title"))).alias("pos", "s"))
    return found.select("doc_id", "pos", "s.text", "s.path", "s.level")


@query(f"with {_LINES} select doc_id, pos::integer as pos, text, path, level::integer as level from sect")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


@query("with p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from documents) select doc_id, (generate_subscripts(l, 1) - 1)::integer as pos, unnest(l) as paragraph from p")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"), "\n")).alias("pos", "paragraph"))


@query(r"""
with shield as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(text, 'Dr.', chr(57344)), 'Mr.', chr(57345)), 'Mrs.', chr(57346)), 'Ms.', chr(57347)), 'vs.', chr(57348)), 'etc.', chr(57349)), 'i.e.', chr(57350)), 'e.g.', chr(57351)) as t from documents),
held as (select doc_id, regexp_replace(regexp_replace(t, '([A-Z])\.', '\1' || chr(57360), 'g'), '\.\.\.', chr(57361), 'g') as t from shield),
marked as (select doc_id, regexp_replace(t, '([.!?])\s+([A-Z"])', '\1' || chr(57362) || '\2', 'g') as t from held),
free as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, chr(57360), '.'), chr(57361), '...'), chr(57344), 'Dr.'), chr(57345), 'Mr.'), chr(57346), 'Mrs.'), chr(57347), 'Ms.'), chr(57348), 'vs.'), chr(57349), 'etc.'), chr(57350), 'i.e.'), chr(57351), 'e.g.') as t from marked),
parts as (select doc_id, list_filter(list_transform(string_split(t, chr(57362)), lambda x: trim(x, ' ' || chr(10) || chr(9))), lambda x: x <> '') as l from free)
select doc_id, (generate_subscripts(l, 1) - 1)::integer as pos, unnest(l) as sentence from parts""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


_PARTS = "para as (select doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as p, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) as i from documents), sized as (select doc_id, i, length(p) // 4 as n from para)"


@query(f"""
with recursive {_PARTS},
walk as (select doc_id, i, n as s, 0 as g from sized where i = 1
  union all select z.doc_id, z.i, case when w.s > 0 and w.s + z.n > 100 then z.n else w.s + z.n end, w.g + case when w.s > 0 and w.s + z.n > 100 then 1 else 0 end from walk w join sized z on z.doc_id = w.doc_id and z.i = w.i + 1)
select doc_id, (i - 1)::integer as pos, g::integer as pack from walk""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.pack(F.transform(parts, T.token_estimate), 100)).alias("pos", "pack"))
    return packed


@query(f"""
with recursive {_LINES.replace('md as', 'md as', 1)},
n as (select *, count(*) over (partition by doc_id) as total from sect),
walk as (select doc_id, pos, path, total, text as whole, length(text) // 4 < 50 and pos < total - 1 as small from n where pos = 0
  union all select z.doc_id, z.pos, z.path, z.total, case when w.small then w.whole || chr(10) || chr(10) || z.text else z.text end,
    length(case when w.small then w.whole || chr(10) || chr(10) || z.text else z.text end) // 4 < 50 and z.pos < z.total - 1 from walk w join n z on z.doc_id = w.doc_id and z.pos = w.pos + 1)
select doc_id, (row_number() over (partition by doc_id order by pos) - 1)::integer as pos, whole as text, path from walk where not small""")
def chunk_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = markdown(spark, sf_dir).withColumn("s", chunking.sections(F.col("markdown"), F.col("title")))
    return split.select("doc_id", F.posexplode(chunking.merge_small(F.col("s"), 50)).alias("pos", "c")).select("doc_id", "pos", "c.text", "c.path")


@query("with w as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as n from documents) select count(*) as n, sum(n)::bigint as total, median(n)::double as median from w")
def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.sizes(table(spark, sf_dir, "documents").select(T.word_count(F.col("text")).alias("w")), "w")


@query("""
with a as (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) as place from documents), b as (select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id desc) as place from documents)
select doc_id, n_chars, place::integer as place, 'smallest' as side from a where place <= 10 union all select doc_id, n_chars, place::integer, 'largest' from b where place <= 10""")
def top_small_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.extremes(table(spark, sf_dir, "documents"), "n_chars", "doc_id")


@query("with t as (select length(text) // 4 as n from documents) select sum(n)::bigint as tokens, (sum(n) // count(*))::bigint as mean_tokens, max(n)::integer as most from t")
def token_estimate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select(T.token_estimate(F.col("text")).alias("n"))
    return t.agg(F.sum("n").alias("tokens"), F.floor(F.sum("n") / F.count(F.lit(1))).cast("long").alias("mean_tokens"), F.max("n").alias("most"))


@query(r"""
with m as (select doc_id, regexp_extract_all(text, '[A-Z][a-z]{3,}') as l from documents), e as (select doc_id, unnest(l) as name, generate_subscripts(l, 1) as p from m),
c as (select doc_id, name, count(*) as n, min(p) as p from e group by all), r as (select *, row_number() over (partition by doc_id order by n desc, p) as place from c)
select doc_id, string_agg(name, '|' order by place) as names from r where place <= 5 group by doc_id""")
def character_names_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = F.regexp_replace("text", "([A-Z][a-z]{3,})", "[[$1]]")
    names = metadata.extract(table(spark, sf_dir, "documents").select("doc_id", linked.alias("chunk_text"))).where(F.size("character_names") > 0)
    return names.select("doc_id", F.array_join("character_names", "|").alias("names"))


_BOOKS = """'Codex: ' || p_name || ', White Dwarf ' || p_size || '. Horus Heresy: Book ' || p_size || ': ' || p_brand || '. Index: ' || p_type"""


@query(f"""
with t as (select p_partkey, {_BOOKS} as t from part), f as (
select p_partkey, trim(unnest(regexp_extract_all(t, 'Codex:\\s*([^,.\\n]+)', 1))) as b from t union all select p_partkey, trim(unnest(regexp_extract_all(t, 'Index:\\s*([^,.\\n]+)', 1))) from t
union all select p_partkey, regexp_extract(t, 'Horus Heresy:\\s*Book\\s+(\\d+)[:\\s]*([^,.\\n]+)', 1) || ' ' || trim(regexp_extract(t, 'Horus Heresy:\\s*Book\\s+(\\d+)[:\\s]*([^,.\\n]+)', 2)) from t
union all select p_partkey, trim(unnest(regexp_extract_all(t, 'Horus Heresy:\\s*([^,.\\n]+)', 1))) from t union all select p_partkey, trim(unnest(regexp_extract_all(t, 'White Dwarf\\s+(\\d+)', 1))) from t)
select p_partkey, string_agg(distinct b, '|' order by b) as books from f where b <> '' group by 1""")
def source_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda n: F.col(n).cast("string")
    text = F.concat(F.lit("Codex: "), c("p_name"), F.lit(", White Dwarf "), c("p_size"), F.lit(". Horus Heresy: Book "), c("p_size"), F.lit(": "), c("p_brand"), F.lit(". Index: "), c("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.source_books(text), "|").alias("books"))


@query(r"""
with t as (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as t from pages),
n as (select page_id, regexp_replace(regexp_replace(regexp_replace(translate(strip_accents(t), ' /:', '_--'), '[^a-zA-Z0-9_-]', '', 'g'), '_+', '_', 'g'), '-+', '-', 'g') as n from t),
s as (select page_id, regexp_replace(n, '^[_-]+|[_-]+$', '', 'g') as n from n)
select page_id, nullif(n, '') as name from s""")
def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_filename(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("name"))


@query("select doc_id || '_' || (n_chars % 7) as id, doc_id::varchar as page, (n_chars % 7)::varchar as chunk_index, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select(T.chunk_id(F.col("doc_id"), F.col("n_chars") % 7).alias("id"), T.preview(F.col("text")).alias("preview"))
    page, index = T.chunk_id_parts(F.col("id"))
    return made.select("id", page.alias("page"), index.alias("chunk_index"), "preview")


# --- ingest state -------------------------------------------------------------------------

#: All documents come in; those stored before have other ids for every third document, so that there is something to add.
_VERSIONS = "a as (select doc_id, 'v' || (n_chars % 10) as last_updated from documents), s as (select case when doc_id % 3 = 0 then -doc_id - 1 else doc_id end as doc_id, 'v' || (n_chars % 7) as stored from documents)"


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    v = lambda n: F.concat(F.lit("v"), (F.col("n_chars") % n).cast("string"))
    known = F.when(F.col("doc_id") % 3 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return docs.select(F.col("doc_id").alias("wiki_id"), v(10).alias("last_updated")), docs.select(known.alias("wiki_id"), v(7).alias("stored"))


@query(f"with {_VERSIONS} select doc_id as wiki_id, last_updated, case when stored is null then 'add' when last_updated <> stored then 'update' else 'skip' end as action from a left join s using (doc_id)")
def change_detect_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.changes(*_versions(spark, sf_dir))


@query(f"with {_VERSIONS} select doc_id as wiki_id, last_updated, case when stored is null then 'add' when last_updated > stored then 'update' else 'skip' end as action from a left join s using (doc_id)")
def change_detect_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.changes(*_versions(spark, sf_dir), mode="newer")


@query("""
with new as (select case when doc_id % 2 = 0 then doc_id else -doc_id - 1 end as doc_id, lang || '-new' as lang from documents)
select doc_id, lang from documents where doc_id not in (select doc_id from new) union all select doc_id, lang from new""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are stored, and all come in again, half of them with new keys."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    key = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-F.col("doc_id") - 1)
    return ingest.merge(docs, docs.select(key.alias("doc_id"), F.concat("lang", F.lit("-new")).alias("lang")), "doc_id")


@query("select doc_id, source from documents where source <> 'src3' and source <> 'src7'")
def delete_by_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ingest.without(docs, spark.createDataFrame([("src3",), ("src7",)], "source string"), "source")


_STATE = "p as (select event_id, case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'click' then 'processing' else 'pending' end as status, (event_id // 100)::integer as batch_number from events)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "click", "processing").otherwise("pending")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("article_id"), status.alias("status"), F.floor(F.col("event_id") / 100).cast("int").alias("batch_number"))


@query(f"with {_STATE} select event_id as article_id, case when event_id % 10 = 0 then 'failed' else status end as status, batch_number, case when event_id % 10 = 0 then 'stopped' end as error_message from p")
def progress_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir).withColumn("error_message", F.lit(None).cast("string"))
    return ingest.move(rows, rows.where("article_id % 10 = 0"), "failed", "stopped").select("article_id", "status", "batch_number", "error_message")


@query(f"with {_STATE} select event_id as article_id, case when status = 'processing' then 'pending' else status end as status, batch_number from p")
def rollback_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.roll_back(_progress(spark, sf_dir))


@query(f"with {_STATE} select coalesce(max(batch_number) filter (status = 'completed'), 0)::integer as last_batch from p")
def last_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.last_batch(_progress(spark, sf_dir))


@query("select doc_id, ((row_number() over (order by doc_id) - 1) // 100 + 1)::integer as batch from documents")
def batch_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.batches(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# --- validation ---------------------------------------------------------------------------


@query("""
with r as (select doc_id, list_filter([case when length(text) // 4 < 50 then 'too few tokens' end, case when length(text) // 4 > 500 then 'too many tokens' end], lambda x: x is not null) as i, trim(text) = '' as blank from documents)
select doc_id, case when blank then false else len(i) = 0 end as valid, case when blank then 'no text' else array_to_string(i, '|') end as issues from r""")
def validate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chunk_text"), F.col("source").alias("article_title"), F.col("lang").alias("section_path"))
    return rows.select("doc_id", quality.check_chunk().alias("r")).select("doc_id", "r.valid", F.array_join("r.issues", "|").alias("issues"))


@query("""
with r as (select doc_id, text, regexp_replace(text, '\\s', '', 'g') = '' as blank from documents)
select doc_id, not blank as valid, case when blank then 'empty' else '' end as issues, case when not blank and length(trim(text)) < 50 then 'short' else '' end as warnings from r""")
def validate_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", quality.check_markdown("text").alias("r"))
    return rows.select("doc_id", "r.valid", F.array_join("r.issues", "|").alias("issues"), F.array_join("r.warnings", "|").alias("warnings"))


@query("""
with v as (select vec_id, embedding::double[] as e from embeddings), n as (select vec_id, len(e) as d, sqrt(list_inner_product(e, e)) as n from v)
select vec_id, d = 64 as valid, case when d <> 64 then 'dimension' else '' end as issues, case when n < 0.99 or n > 1.01 then 'norm' else '' end as warnings from n""")
def validate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quality.check_embedding(dimensions=64).alias("r"))
    return rows.select("vec_id", "r.valid", F.array_join("r.issues", "|").alias("issues"), F.array_join("r.warnings", "|").alias("warnings"))


@query("""
with r as (select length(text) // 4 < 50 or length(text) // 4 > 500 as bad from documents)
select count(*) filter (not bad) as n_valid, count(*) filter (bad) as n_invalid, 0::bigint as n_warned, round(100.0e0 * count(*) filter (bad) / count(*), 6) as invalid_rate from r""")
def validation_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("text").alias("chunk_text"), F.col("source").alias("article_title"), F.col("lang").alias("section_path"))
    return quality.metrics(rows.select(quality.check_chunk().alias("r")))


# --- analytics ----------------------------------------------------------------------------


@query("""
with u as (select conv_id, turn, case when role = 'user' then 'gpt-4.1' else 'claude-sonnet-4-5' end as model, length(text) // 4 as t from conversations),
c as (select model, count(*) as n, sum(t)::bigint as tokens, sum(t / 1000.0e0 * case when model = 'gpt-4.1' then 0.002e0 else 0.003e0 end + (t // 2) / 1000.0e0 * case when model = 'gpt-4.1' then 0.008e0 else 0.006e0 end) as c from u group by 1)
select model, n, tokens, round(c, 6) as cost_usd from c""")
def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.token_estimate(F.col("text"))
    usage = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "gpt-4.1").otherwise("claude-sonnet-4-5").alias("model"), t.alias("prompt_tokens"), F.floor(t / 2).alias("completion_tokens"))
    return analytics.costs(usage).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").cast("long").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("""
with a as (select user_id, user_id % 5 as server_id, strftime(ts, '%Y-%m') as month, round(sum(value), 6) as total_points, count(*) filter (event_type = 'purchase') as correct_answers, count(*) as total_attempts from events group by all)
select *, round(correct_answers / total_attempts, 6) as success_rate, row_number() over (partition by server_id, month order by total_points desc, user_id)::integer as rank from a""")
def leaderboard_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return analytics.leaderboard(e.select("user_id", (F.col("user_id") % 5).alias("server_id"), "ts", F.col("value").alias("points"), (F.col("event_type") == "purchase").alias("is_correct")))


@query("""
select user_id % 5 as server_id, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(avg((event_type <> 'error')::integer), 6) as success_rate from events group by 1""")
def query_latency_by_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latency(table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("server_id"), F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok")))


@query("""
select event_id, user_id, count(*) over (partition by user_id order by floor(epoch(ts))::bigint range between 3600 preceding and current row) as n_window,
  count(*) over (partition by user_id order by floor(epoch(ts))::bigint range between 3600 preceding and current row) > 2 as limited from events""")
def rate_limit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.in_window(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", 3600, 2).drop("ts")


@query("select conv_id, turn, coalesce(string_agg(text, chr(10)) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding), '') as context from conversations")
def followup_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.follow_up(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "context")


@query(f"""
with {_BM25}, {_searched('select item_id as query_id, text from benchmark', 10)},
rel as (select item_id as query_id, doc_id, 1 + doc_id % 3 as grade from benchmark join documents on contains(documents.text, benchmark.text)),
i as (select *, row_number() over (partition by query_id order by grade desc, doc_id) as i from rel),
t as (select query_id, count(*) as n, sum(case when i <= 10 then grade / log2(i + 1.0e0) end) as idcg from i group by 1),
g as (select query_id, count(*) as found, min(rank) as first, sum(grade / log2(rank + 1.0e0)) as dcg from kw join rel using (query_id, doc_id) group by 1)
select query_id, round(coalesce(found / 10, 0), 6) as precision, round(coalesce(found / n, 0), 6) as recall, round(coalesce(1 / first, 0), 6) as reciprocal_rank, round(coalesce(dcg / idcg, 0), 6) as ndcg from t left join g using (query_id)""")
def eval_recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = analytics.containing(docs, items, "text", "text")
    relevant = held.select("query_id", F.col("doc_id").alias("chunk_id"), (1 + F.col("doc_id") % 3).alias("grade"))
    return analytics.retrieval_quality(keyword.search(_index(spark, sf_dir), items, 10), relevant)


@query("select min(doc_id) as doc_id, text from documents group by text")
def dedupe_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


# --- prompts and answers ------------------------------------------------------------------


@query("select conv_id, turn, '## Context' || chr(10) || role || chr(10) || chr(10) || '## Question' || chr(10) || text || chr(10) as prompt from conversations")
def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.user_prompt(F.col("role"), F.col("text")).alias("prompt"))


_ANSWER = """ans as (select conv_id, turn, turn % 3 = 0 as smalltalk, case when turn % 4 <> 1 then role end as answer, 'reply ' || turn as reply, turn % 8 as n from conversations)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    urls = F.transform(F.sequence(F.lit(0), (t % 8).cast("int")), lambda i: F.concat(F.lit("http://x.org/"), i.cast("string")))
    whole = F.struct(F.when(t % 4 != 1, F.col("role")).alias("answer"), F.concat(F.lit("reply "), t.cast("string")).alias("personality_reply"), F.slice(urls, F.lit(2), (t % 8).cast("int")).alias("sources"), (t % 3 == 0).alias("smalltalk"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(whole).alias("answer"))


@query(f"""
with {_ANSWER} select conv_id, turn, case when smalltalk then reply else coalesce(answer || chr(10), '') || chr(10) || reply
  || case when n > 0 then chr(10) || chr(10) || '📚 Sources:' || chr(10) || array_to_string(list_transform(range(1, least(n, 5) + 1), lambda i: '- http://x.org/' || i), chr(10)) else '' end end as shown from ans""")
def format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("conv_id", "turn", answers.display(F.col("answer"), "en").alias("shown"))


@query(f"with {_ANSWER} select conv_id, turn, smalltalk or (answer is not null and n > 0) as valid, case when smalltalk then '' else concat_ws('|', case when answer is null then 'answer' end, case when n = 0 then 'sources' end) end as issues from ans")
def structured_answer_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = _answers(spark, sf_dir).select("conv_id", "turn", quality.check_answer().alias("r"))
    return checked.select("conv_id", "turn", "r.valid", F.array_join("r.issues", "|").alias("issues"))


@query("select role, case when role = 'user' then 'openai' else 'anthropic' end as provider, count(*) as n from conversations group by all")
def model_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("role") == "user", "gpt-4.1").otherwise("claude-sonnet-4-5")
    return table(spark, sf_dir, "conversations").groupBy("role", answers.provider(model).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


# --- markup -------------------------------------------------------------------------------


def _html_sql() -> str:
    """The steps one by one; what a tag's end closes is spelled out for each tag."""
    out = "html"
    steps = [(rf"(?s)<{t}\b[^>]*>.*?</{t}>", "") for t in ("head", "script", "style", "nav", "footer")] + [(r"(?s)<!--.*?-->", "")]
    steps += [(rf"(?i)<h{n}[^>]*>", "\n\n" + "#" * n + " ") for n in (1, 2, 3, 4)] + [(r"(?i)</h[1-6]>", "\n\n"), (r"(?i)<li[^>]*>", "\n- "), (r"(?i)<(?:p|div|br)\b[^>]*>", "\n\n"), (r"(?i)</(p|div)>", "\n\n")]
    steps += [(r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"), (r"(?i)</?(?:b|strong)>", "**"), (r"(?i)</?(?:i|em)>", "*"), ("<[^>]+>", "")]
    steps += [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")]
    for pattern, new in steps:
        pattern, new = pattern.replace("'", "''"), new.replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"select page_id, {out} as markdown from pages"


@query(_html_sql())
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", wikitext.html_to_markdown(F.col("html")).alias("markdown"))


# --- sources, read from texts in memory ----------------------------------------------------


@query("""
select doc_id::varchar as wiki_id, 'Doc ' || doc_id as title, case when doc_id % 3 = 0 then '' else '2024-01-0' || (doc_id % 9 + 1) end as last_updated, lang as text
from documents where doc_id % 7 <> 0 and doc_id % 5 <> 1""")
def xml_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page filter and projection of the XML source: other namespaces and redirects go, a missing time is empty."""
    from skein.sources.wiki import PAGE, article_pages

    d = F.col("doc_id")
    n = d.cast("string")
    stamp = F.when(d % 3 != 0, F.concat(F.lit("<timestamp>2024-01-0"), (d % 9 + 1).cast("string"), F.lit("</timestamp>"))).otherwise("")
    xml = F.concat(
        F.lit("<page><title>Doc "), n, F.lit("</title><ns>"), F.when(d % 7 == 0, "1").otherwise("0"), F.lit("</ns><id>"), n, F.lit("</id>"),
        F.when(d % 5 == 1, '<redirect title="X"/>').otherwise(""), F.lit("<revision>"), stamp, F.lit('<text bytes="2">'), F.col("lang"), F.lit("</text></revision></page>"),
    )
    raw = table(spark, sf_dir, "documents").select(F.from_xml(xml, PAGE, {"rowTag": "page"}).alias("p")).select("p.*")
    return article_pages(raw).withColumn("last_updated", F.substring("last_updated", 1, 10))


@query("select doc_id::varchar as wiki_id, 'It''s ' || doc_id as title, lang as last_updated, trim(text, ' ' || chr(10) || chr(9)) as content, n_chars::integer as word_count from documents")
def markdown_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as archive files' texts and parsed again."""
    from skein.sources import archive

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("wiki_id"), F.concat(F.lit("It's "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("last_updated"), F.col("text").alias("content"), F.col("n_chars").cast("int").alias("word_count"))
    return archive.parsed(archive.render(docs).select(F.col("name").alias("path"), "raw")).drop("path")


# the further modules register their queries when they are imported
from skein.plans import articles, commands, files, states, streams  # noqa: E402

__all__ = ["ORACLE_SQL", "QUERIES", "articles", "commands", "files", "states", "streams"]
