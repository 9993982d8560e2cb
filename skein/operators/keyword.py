"""BM25 keyword index and search.

The index is built once, from the texts, and lies in Parquet folders: postings
(term, chunk_id, pos, dl, tf) in buckets by a hash of the term, terms (term, df, idf), the first chunks by
position, and one row of statistics, which is also held on the driver.  Chunks are dealt by a hash of their id into
blocks of about ``BLOCK`` bytes of text.  A task counts and sorts one block and writes it to one file a bucket, so texts are the
only rows that are shuffled, and its memory doesn't grow with the input.  Files are sorted by term, so that a search reads
the folders and row groups of its terms only.

Queries come in batches: every operator carries ``query_id``, so many
queries are one job.  Scores are rounded before they are ordered, so ties don't depend on
the order of a sum.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein import log, shared
from skein.functions.text import tokens
from skein.session import ValidationError

#: Fixed values of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: First chunks by position that an index holds, to fill short lists; queries of a batch that are read by the driver; files that are looked at one by one.
FILLERS, FEW_QUERIES, FEW_FILES = 2000, 1000, 256
#: Buckets of terms; bytes of text in a block of chunks, and less where there would be fewer blocks than cores.
BUCKETS, BLOCK, LEAST_BLOCK = 8, 16 << 20, 1 << 20
#: Rows (query, chunk) that one task of a search sums up.
SUMMED = 1_000_000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class KeywordIndex:
    """An index under ``path``, with its statistics in ``facts``."""

    spark: SparkSession
    path: str
    facts: dict

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}")

    @property
    def lowercase(self) -> bool:
        return self.facts["lowercase"]

    @property
    def postings(self) -> DataFrame:
        return self.read("postings").where("term <> ''")

    @property
    def docs(self) -> DataFrame:
        return self.read("postings").where((F.col("bucket") == _bucket(F.lit(""))) & (F.col("term") == "")).select("chunk_id", "pos", "dl")

    @property
    def terms(self) -> DataFrame:
        idf = F.when(F.col("raw") >= 0, F.col("raw")).otherwise(F.lit(EPSILON * (self.facts["avg_idf"] or 0.0)))
        return self.read("terms").select("term", "df", idf.alias("idf"))

    @property
    def stats(self) -> DataFrame:
        return self.read("stats")

    def save(self, path: str) -> None:
        """A copy of the index under ``path``; the statistics come last, so an index with them is complete."""
        shared.delete(self.spark, f"{path}/stats")
        self.read("postings").repartition(self.facts["blocks"], "chunk_id").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        for table in ("terms", "fillers", "stats"):
            self.read(table).write.mode("overwrite").parquet(f"{path}/{table}")


def load(spark: SparkSession, path: str) -> KeywordIndex:
    return KeywordIndex(spark, path, spark.read.parquet(f"{path}/stats").first().asDict())


def build(chunks: DataFrame, id_column: str = "chunk_id", text: str = "chunk_text", order: str | None = None, lowercase: bool = False, path: str | None = None) -> KeywordIndex:
    """An index of ``chunks`` under ``path`` (a new one in the shared folder by default); ``order`` (the id by default) breaks ties between scores; no chunks is an error."""
    spark = chunks.sparkSession
    given = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0)).alias("size")).first()
    if not given["n"]:
        raise ValidationError("there are no chunks to index")
    blocks = max(-(-given["size"] // BLOCK), min(spark.sparkContext.defaultParallelism, -(-given["size"] // LEAST_BLOCK)), 1)
    path = path or shared.scratch(spark, "keyword")
    shared.delete(spark, f"{path}/stats")
    words = chunks.select(F.col(id_column).alias("chunk_id"), F.col(order or id_column).alias("pos"), F.coalesce(text, F.lit("")).alias("t")).repartition(blocks, "chunk_id")
    words = words.select("chunk_id", "pos", tokens(F.col("t"), lowercase).alias("words"))
    # a posting carries its chunk's position and length, so a search joins nothing else; the empty term, which
    # no text has, stands for the chunk itself, so that chunks without words come out of the same pass.
    # Chunks are dealt out by their ids, so their words are counted where they are
    each = words.select("chunk_id", "pos", F.size("words").cast("long").alias("dl"), F.explode(F.concat("words", F.array(F.lit("")))).alias("term"))
    counted = each.groupBy("term", "chunk_id", "pos", "dl").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("term")))
    counted.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    index = KeywordIndex(spark, path, {"lowercase": lowercase, "avg_idf": None})
    sizes = index.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_tokens")).first()
    df = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df.select("term", "df", (F.log(F.lit(sizes["n_docs"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    mean = index.read("terms").agg(F.avg("raw").alias("avg_idf"), F.count(F.lit(1)).alias("n_terms")).first()
    index.docs.orderBy("pos").limit(FILLERS).select("chunk_id", "pos").coalesce(1).write.mode("overwrite").parquet(f"{path}/fillers")
    facts = {"n_docs": sizes["n_docs"], "avgdl": sizes["avgdl"], "n_tokens": sizes["n_tokens"], "avg_idf": mean["avg_idf"], "n_terms": mean["n_terms"], "lowercase": lowercase, "blocks": blocks}
    kinds = {"n_docs": "long", "avgdl": "double", "n_tokens": "long", "avg_idf": "double", "n_terms": "long", "lowercase": "boolean", "blocks": "int"}
    spark.range(1).select(*(F.lit(facts[n]).cast(k).alias(n) for n, k in kinds.items())).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
    log.event("keyword_index_built", path=path, **facts)
    return KeywordIndex(spark, path, facts)


#: Indexes that ``stored`` has opened, by application and path.
_LOADED: dict[tuple[str, str], KeywordIndex] = {}


def _mark(chunks: DataFrame) -> str:
    """What tells the files that ``chunks`` reads from others: names, sizes and times."""
    spark, files = chunks.sparkSession, sorted(chunks.inputFiles())
    if len(files) > FEW_FILES:
        named = chunks.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
        return str(tuple(named.agg(F.count(F.lit(1)), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()))
    out = []
    for f in files:
        place = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        out.append((f, status.getLen(), status.getModificationTime()))
    return str(out)


def stored(chunks: DataFrame, name: str, id_column: str = "chunk_id", text: str = "chunk_text", order: str | None = None, lowercase: bool = False) -> KeywordIndex:
    """The index of ``chunks`` in the shared folder under ``name``, built if it isn't there or if the files that ``chunks`` reads have changed."""
    spark = chunks.sparkSession
    mark = hashlib.sha256(f"{name} {_mark(chunks)} {id_column} {text} {order} {lowercase}".encode()).hexdigest()
    path = f"{shared.folder(spark)}/keyword-{mark[:32]}"
    if (spark.sparkContext.applicationId, path) not in _LOADED:  # a path names its content
        made = load(spark, path) if shared.exists(spark, f"{path}/stats/_SUCCESS") else build(chunks, id_column, text, order, lowercase, path)
        _LOADED[spark.sparkContext.applicationId, path] = made
    return _LOADED[spark.sparkContext.applicationId, path]


def stats(index: KeywordIndex) -> DataFrame:
    """One row: number of chunks, tokens and distinct tokens, mean length."""
    return index.stats.select("n_docs", "n_tokens", "n_terms", "avgdl")


def query_terms(queries: DataFrame, lowercase: bool = False) -> DataFrame:
    """``(query_id, term, times)`` of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tokens(F.col("text"), lowercase)).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))


def _asked(index: KeywordIndex, queries: DataFrame, check: bool) -> tuple[DataFrame, DataFrame, dict[str, int] | None, int]:
    """``(query_id)`` of the queries, their terms ``(query_id, term, weight)`` with weight = times * idf, and, if the batch is small, each term's bucket and how many rows (query, chunk) there are at most."""
    spark = queries.sparkSession
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    few = queries.select("query_id", tokens(F.coalesce("text", F.lit("")), index.lowercase).alias("words"), blank.alias("blank")).limit(FEW_QUERIES + 1).collect()
    if len(few) > FEW_QUERIES:
        if check and queries.where(blank).take(1):
            raise ValidationError("a query is empty")
        weighed = query_terms(queries, index.lowercase).join(index.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))
        return queries.select("query_id").distinct(), weighed, None, 0
    if check and any(r["blank"] for r in few):
        raise ValidationError("a query is empty")
    kind = queries.schema["query_id"].dataType.simpleString()
    terms = sorted({w for r in few for w in r["words"]})
    found = index.terms.where(F.col("term").isin(terms)).withColumn("bucket", _bucket(F.col("term"))).collect() if terms else []  # no more than the queries' own terms
    idf = {r["term"]: r["idf"] for r in found}
    weighed = [(r["query_id"], w, float(n * idf[w])) for r in few for w, n in Counter(r["words"]).items() if w in idf]
    names, df = dict.fromkeys(r["query_id"] for r in few), {r["term"]: r["df"] for r in found}
    most = min(sum(df[w] for _, w, _ in weighed), len(names) * index.facts["n_docs"])
    ids = spark.createDataFrame([(i,) for i in names], f"query_id {kind}")
    return ids, spark.createDataFrame(weighed, f"query_id {kind}, term string, weight double"), {r["term"]: r["bucket"] for r in found}, most


def search(index: KeywordIndex, queries: DataFrame, k: int = 20, check: bool = True) -> DataFrame:
    """``(query_id, chunk_id, score, rank)``: each query's ``k`` best chunks, ties by position.

    Chunks without a query term score 0 and fill up a list that is too short, in order of
    position.  A list of ``k`` needs no more than the first 2k chunks for that, unless the
    mean idf is negative (a tiny corpus), when all may be needed.
    """
    ids, weighed, terms, most = _asked(index, queries, check)
    postings = index.postings
    if terms is not None:
        # postings are dealt by chunk before they meet the queries: a task sums up all of its chunks' rows
        # and keeps k a query, so only postings and these few rows are shuffled
        postings = postings.where(F.col("bucket").isin(sorted(set(terms.values()))) & F.col("term").isin(sorted(terms)))
        postings = postings.repartition(-(-most // SUMMED) or 1, "chunk_id")
        weighed = F.broadcast(weighed)  # the terms of at most FEW_QUERIES queries
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.facts["avgdl"] or 1.0)))
    hits = postings.join(weighed, "term").select("query_id", "chunk_id", "pos", (F.col("weight") * part).alias("part"))
    negative = (index.facts["avg_idf"] or 0) < 0
    if negative:
        first = index.docs.select("chunk_id", "pos")
    else:
        first = (index.read("fillers") if 2 * k <= FILLERS else index.docs.select("chunk_id", "pos")).orderBy("pos").limit(2 * k)
    blank = first.crossJoin(F.broadcast(ids) if terms is not None else ids)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")

    def best(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def summed(parts: DataFrame) -> DataFrame:
        return parts.groupBy("query_id", "chunk_id").agg(F.first("pos").alias("pos"), F.round(F.sum("part"), 6).alias("score"))

    if negative:
        return best(summed(hits.unionByName(blank.select("query_id", "chunk_id", "pos", F.lit(0.0).alias("part"))))).select("query_id", "chunk_id", "score", "rank")
    # no score is below 0 here, so a chunk whose hit isn't among the k best can't come in by its blank row either
    found = best(summed(hits)).drop("rank").unionByName(blank.select("query_id", "chunk_id", "pos", F.lit(0.0).alias("score")))
    return best(found.groupBy("query_id", "chunk_id").agg(F.first("pos").alias("pos"), F.max("score").alias("score"))).select("query_id", "chunk_id", "score", "rank")
