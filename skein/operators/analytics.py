"""Statistics and analytics: sizes, leaderboards, rates, costs, retrieval quality, follow-up context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import shared
from skein.functions.text import tokens

#: USD for 1000 tokens, input and output.
PRICES = {
    "gpt-4.1": (0.002, 0.008),
    "claude-haiku-4-5": (0.001, 0.005),
    "claude-sonnet-4-5": (0.003, 0.006),
    "claude-opus-4-5": (0.005, 0.025),
    "text-embedding-3-small": (0.00002, 0.0),
}


def quantiles(rows: DataFrame, column: str, shares: dict[str, float], by: list[str]) -> DataFrame:
    """Exact quantiles of a number, by linear interpolation: a row for each group with a column for each name of ``shares``.

    Values are counted and range-sorted by (group, value), so that a large group spreads over many
    tasks; a value's rank is its rank in its partition after the group's rows in the partitions before.
    """
    counted = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    placed = shared.materialise(counted.repartitionByRange(*by, "_v").withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy(*by, "_p").agg(F.sum("_n").alias("_size"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_size").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.withColumns({"_before": before, "_total": F.sum("_size").over(whole)}).drop("_size")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.join(starts, [*by, "_p"]).withColumn("_upto", upto)

    def at(place):
        return F.max(F.when((F.col("_upto") - F.col("_n") <= place) & (place < F.col("_upto")), F.col("_v")))

    found = []
    for name, share in shares.items():
        h = (F.col("_total") - 1) * F.lit(float(share))
        found += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_part_{name}")]
    mixed = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares]
    return ranked.groupBy(*by).agg(*found).select(*by, *mixed)


def sizes(rows: DataFrame, column: str) -> DataFrame:
    """One row: count, sum, exact median of a number."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(column), F.lit(0)).cast("long").alias("total")).withColumn("_g", F.lit(0))
    return one.join(quantiles(rows.select(F.lit(0).alias("_g"), column), column, {"median": 0.5}, ["_g"]), "_g", "left").drop("_g")


def extremes(rows: DataFrame, column: str, key: str, k: int = 10) -> DataFrame:
    """The ``k`` smallest (ties by key) and ``k`` largest (ties by key, reversed) rows, with ``side`` and ``place``."""
    def side(name: str, *order) -> DataFrame:
        top = rows.select(key, column).orderBy(*order).limit(k)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("side", F.lit(name))  # over k rows

    return side("smallest", column, key).unionByName(side("largest", F.desc(column), F.desc(key)))


def latest(rows: DataFrame, column: str) -> DataFrame:
    """The largest text of a column, the empty text aside."""
    return rows.agg(F.max(F.nullif(F.col(column), F.lit(""))).alias("latest"))


def prices(spark) -> DataFrame:
    return spark.createDataFrame([(m, *p) for m, p in PRICES.items()], "model string, input double, output double")


def cost(model: str, prompt_tokens: int, completion_tokens: int = 0) -> float:
    """Cost of one call; an unknown model is an error."""
    if model not in PRICES:
        raise ValueError(f"unknown model {model}; known: {', '.join(PRICES)}")
    return prompt_tokens / 1000 * PRICES[model][0] + completion_tokens / 1000 * PRICES[model][1]


def costs(usage: DataFrame) -> DataFrame:
    """Usage (model, prompt_tokens, completion_tokens) with ``cost_usd``: a join with the five prices."""
    each = F.col("prompt_tokens") / 1000 * F.col("input") + F.col("completion_tokens") / 1000 * F.col("output")
    return usage.join(F.broadcast(prices(usage.sparkSession)), "model", "left").withColumn("cost_usd", each).drop("input", "output")


def leaderboard(attempts: DataFrame) -> DataFrame:
    """Points by user, server and month, with the rank within server and month (ties by user).

    ``attempts`` has (user_id, server_id, ts, points, is_correct).
    """
    by = attempts.groupBy("user_id", "server_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.round(F.sum("points"), 6).alias("total_points"), F.sum(F.when(F.col("is_correct"), 1).otherwise(0)).cast("long").alias("correct_answers"), F.count(F.lit(1)).alias("total_attempts"),
    )
    order = Window.partitionBy("server_id", "month").orderBy(F.desc("total_points"), "user_id")
    return by.withColumn("success_rate", F.round(F.col("correct_answers") / F.col("total_attempts"), 6)).withColumn("rank", F.row_number().over(order))


def latency(logs: DataFrame) -> DataFrame:
    """By server: queries, mean, median and 95th percentile latency, share of successes."""
    by = logs.groupBy("server_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency"), 6).alias("mean"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))
    high = quantiles(logs, "latency", {"p50": 0.5, "p95": 0.95}, ["server_id"])
    return by.join(high, "server_id", "left").select("server_id", "n", "mean", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "success_rate")


def in_window(events: DataFrame, key: str, seconds: int = 60, limit: int = 10) -> DataFrame:
    """Each event with the number of its key's events in the last ``seconds`` (itself included), and whether that passes ``limit``."""
    w = Window.partitionBy(key).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("n_window", F.count(F.lit(1)).over(w)).withColumn("limited", F.col("n_window") > limit)


def follow_up(turns: DataFrame, n: int = 5) -> DataFrame:
    """Each turn with the texts of the ``n`` turns before it, joined by line feeds."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("context", F.array_join(F.collect_list("text").over(w), "\n"))


def retrieval_quality(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """By query: precision@k, recall@k, reciprocal rank and NDCG@k.

    ``hits`` has (query_id, chunk_id, rank) and ``relevant`` (query_id, chunk_id, grade > 0).
    """
    graded = hits.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"])
    gain = lambda g, r: g / F.log2(r + 1.0)
    got = graded.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"))
    ideal = relevant.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "chunk_id")))
    total = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("i") <= k, gain(F.col("grade"), F.col("i")))).alias("idcg"))
    r6 = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    return total.join(got, "query_id", "left").select("query_id", r6(F.col("found") / k, "precision"), r6(F.col("found") / F.col("n"), "recall"), r6(1 / F.col("first"), "reciprocal_rank"), r6(F.col("dcg") / F.col("idcg"), "ndcg"))


def containing(docs: DataFrame, items: DataFrame, doc_text: str, item_text: str) -> DataFrame:
    """Pairs of ``docs`` and ``items`` (other columns of both) where the document's text holds the item's, character by character.

    A word that stands between two others in an item stands as a word in every text that holds the
    item, so pairs are found by joining on the item's longest such word (documents' distinct words
    against it) and then checked.  Items of fewer than three words have none and are
    checked against every document; they can't be told by a word.
    """
    inner = F.regexp_extract(F.col("_item"), r"(?s)^\S*\s+(.*)\s+\S*$", 1)
    longest = F.element_at(F.array_sort(F.transform(tokens(inner), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    held = items.withColumnRenamed(item_text, "_item").withColumn("_word", F.when(F.size(tokens(inner)) > 0, longest))
    words = held.where(F.col("_word").isNotNull())
    named = docs.withColumn("_doc", F.col(doc_text)).drop(doc_text).withColumn("_word", F.explode(F.array_distinct(tokens(F.col("_doc"))))).join(words, "_word")
    named = named.where(F.contains("_doc", "_item")).drop("_word", "_doc", "_item")
    few = held.where(F.col("_word").isNull()).drop("_word")
    if not few.take(1):
        return named
    short = docs.withColumn("_doc", F.col(doc_text)).drop(doc_text).join(few, F.contains("_doc", "_item"))
    return named.unionByName(short.drop("_doc", "_item"))
