"""Links: redirect resolution, the link graph, breadth-first selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import shared
from skein.functions.text import LINK


def resolve(links: DataFrame, redirects: DataFrame, column: str = "link") -> DataFrame:
    """``links`` with ``column`` replaced by its redirect target, one exact step; Spark broadcasts the table if it is small."""
    r = redirects.select(F.col("source").alias("_source"), F.col("target").alias("_target"))
    return links.join(r, links[column] == r["_source"], "left").withColumn(column, F.coalesce("_target", column)).drop("_source", "_target")


def resolve_markdown(articles: DataFrame, redirects: DataFrame, key: str = "wiki_id", text: str = "content") -> DataFrame:
    """Articles whose Markdown links point to redirect targets; only articles with such links are rebuilt."""
    used = articles.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)))).alias("link"))
    hits = used.join(redirects, used.link == redirects.source).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("_targets"))
    # all links are replaced in one step, so that a target which is a source itself stays
    target = lambda m: F.element_at("_targets", F.regexp_extract(m, LINK, 2))
    new = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda m: F.coalesce(F.concat(F.lit("["), F.regexp_extract(m, LINK, 1), F.lit("]("), target(m), F.lit(")")), m))
    swap = F.array_join(F.zip_with(F.split(text, LINK, -1), new, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    return articles.join(hits, key, "left").withColumn(text, F.when(F.col("_targets").isNull(), F.col(text)).otherwise(swap)).drop("_targets")


def incoming(edges: DataFrame, k: int = 10) -> DataFrame:
    """``(title, n)``: the ``k`` most linked titles, ties by title."""
    return edges.groupBy(F.col("dst_title").alias("title")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(k)


def breadth_first(edges: DataFrame, titles: DataFrame, seed: str, most: int = 100, most_depth: int | None = None) -> DataFrame:
    """``(place, id, depth)``: pages in breadth-first order from ``seed``, at most ``most``; of any depth if ``most_depth`` is None.

    ``edges`` has (src_id, dst_title, pos) and ``titles`` (title, id).  They are joined once and
    materialised; each level joins that graph with its frontier.  Within a level pages come in order of (parent's place, link position).  The frontier never
    has more than ``most`` rows, so it may be held on the driver between levels; links to
    titles that don't exist are passed over.
    """
    spark = edges.sparkSession
    graph = shared.materialise(edges.join(titles, edges.dst_title == titles.title).select("src_id", F.col("id").alias("dst"), "pos"))
    found = [(1, seed, 0)]
    seen, level = {seed}, [(1, seed)]
    depth = 0
    while level and len(found) < most and (most_depth is None or depth < most_depth):
        depth += 1
        frontier = spark.createDataFrame(level, "place int, src_id string")
        # a level gives at most `most` new pages; the seen ones among its best candidates are no more than `most` either
        best = graph.join(F.broadcast(frontier), "src_id").groupBy("dst").agg(F.min(F.struct("place", "pos")).alias("at")).orderBy("at", "dst").limit(2 * most)
        level = []
        for r in best.collect():
            if r["dst"] not in seen and len(found) < most:
                seen.add(r["dst"])
                found.append((len(found) + 1, r["dst"], depth))
                level.append((len(found), r["dst"]))
    return spark.createDataFrame(found, "place int, id string, depth int")


def levels(edges: DataFrame, seed, most_depth: int = 3) -> DataFrame:
    """``(node, depth)``: all nodes within ``most_depth`` steps of ``seed`` over ``edges`` (src, dst), without a driver loop over rows.

    The edges and each level's new nodes are materialised, so the plan doesn't grow with the depth.
    """
    edges = shared.materialise(edges.select("src", "dst"))
    reached = edges.sparkSession.createDataFrame([(seed,)], edges.select(F.col("src").alias("node")).schema).withColumn("depth", F.lit(0))
    for depth in range(1, most_depth + 1):
        last = reached.where(F.col("depth") == depth - 1).select(F.col("node").alias("src"))
        new = edges.join(last, "src").select(F.col("dst").alias("node")).distinct().join(reached.select("node"), "node", "left_anti")
        reached = reached.unionByName(shared.materialise(new.withColumn("depth", F.lit(depth))))
    return reached


def titled(places: DataFrame, titles: DataFrame) -> DataFrame:
    """Places with a title each (the last by name for several), "Unknown" where there is none."""
    one = titles.groupBy("id").agg(F.max("title").alias("title"))
    return places.join(one, "id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown")))


def per_article_first(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
