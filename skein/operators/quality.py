"""Data-quality checks: each gives (valid, issues, warnings) for every row, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import token_estimate
from skein.operators.vector import dot

DIMENSIONS, LEAST_TOKENS, MOST_TOKENS, LEAST_CHARS = 1536, 50, 500, 50


def _found(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(cond, text) for cond, text in rules)))


def _result(issues: Column, warnings: Column | None = None) -> Column:
    warnings = warnings if warnings is not None else F.expr("cast(array() as array<string>)")
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"), warnings.alias("warnings"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def check_markdown(text: str = "content") -> Column:
    """Text must not be blank and must have a line that doesn't begin with ``---``; short texts are a warning."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.trim(body), "\n"), lambda l: ~l.startswith("---"))
    blank = F.regexp_replace(body, r"\s", "") == ""
    return _result(_found((blank, "empty"), (~blank & (F.size(lines) == 0), "no content")), _found((~blank & (F.length(F.trim(body)) < LEAST_CHARS), "short")))


def check_chunk(text: str = "chunk_text", title: str = "article_title", path: str = "section_path") -> Column:
    """Text, title and path must be there and the estimated tokens in range; a blank text is the only issue reported."""
    n = token_estimate(F.col(text))
    rest = _found((_blank(title), "no title"), (_blank(path), "no section path"), (n < LEAST_TOKENS, "too few tokens"), (n > MOST_TOKENS, "too many tokens"))
    return _result(F.when(_blank(text), F.array(F.lit("no text"))).otherwise(rest))


def check_embedding(vector: str = "embedding", dimensions: int = DIMENSIONS, kind: str = "float") -> Column:
    """Dimension, NaN and infinity are issues; a norm away from 1 (or another element type) is a warning."""
    v = F.col(vector).cast("array<double>")
    nan, inf = F.exists(v, lambda x: F.isnan(x)), F.exists(v, lambda x: F.abs(x) == float("inf"))
    norm = F.sqrt(dot(v, v))
    issues = _found((F.size(v) != dimensions, "dimension"), (nan, "nan"), (inf, "infinite"))
    warnings = _found((F.lit(kind != "float"), "type"), (~nan & ~inf & ((norm < 0.99) | (norm > 1.01)), "norm"))
    return _result(F.when(F.col(vector).isNull(), F.array(F.lit("dimension"))).otherwise(issues), F.when(F.col(vector).isNull(), F.expr("cast(array() as array<string>)")).otherwise(warnings))


def check_metadata(metadata: str = "metadata") -> Column:
    """A JSON text must hold a ``content_type`` text and a ``spoiler_flag`` boolean (the rule of an older extractor)."""
    m = F.from_json(metadata, "content_type string, spoiler_flag boolean")
    return _result(_found((F.coalesce(m["content_type"], F.lit("")) == "", "content_type"), (m["spoiler_flag"].isNull(), "spoiler_flag")))


def check_xml(raw: DataFrame) -> DataFrame:
    """One row of ``wiki.pages`` checks: at least one page is needed; a first page without title or text is a warning."""
    first = F.min_by(F.struct("title", F.col("revision.text._VALUE").alias("text")), F.col("id").cast("long"))
    one = raw.agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    return one.select(_result(_found((F.col("n") == 0, "no pages")), _found(((F.col("n") > 0) & F.col("first.title").isNull(), "no title"), ((F.col("n") > 0) & F.col("first.text").isNull(), "no text"))).alias("r")).select("r.*")


def check_answer(answer: str = "answer") -> Column:
    """A structured answer in JSON: unless it is small talk it needs an answer and sources, and sources are web addresses."""
    a = F.from_json(answer, "answer string, personality_reply string, sources array<string>, smalltalk boolean")
    lore = ~F.coalesce(a["smalltalk"], F.lit(False))
    return _result(_found(
        (a["personality_reply"].isNull(), "personality_reply"), (a["smalltalk"].isNull(), "smalltalk"),
        (lore & (F.coalesce(a["answer"], F.lit("")) == ""), "answer"), (lore & (F.coalesce(F.size(a["sources"]), F.lit(0)) <= 0), "sources"),
        (F.coalesce(F.exists(a["sources"], lambda u: ~u.rlike(r"^https?://[^\s/]+")), F.lit(False)), "url"),
    ))


def all_valid(result: Column) -> Column:
    return result["valid"] & (F.size(result["issues"]) == 0)


def has_warnings(result: Column) -> Column:
    return F.size(result["warnings"]) > 0


def rate(bad: Column, good: Column) -> Column:
    """100 * bad / (bad + good), 0 where there is nothing."""
    return F.when(bad + good == 0, 0.0).otherwise(100.0 * bad / F.nullif(bad + good, F.lit(0)))


def rounded(number: Column, places: int = 6) -> Column:
    """A number rounded as ``round(x * 10^places) / 10^places``, the way SQL engines do it: ``round`` with places looks at the decimal text, which ends in another digit where the product is just below a half."""
    return F.round(number * float(10**places)) / float(10**places)


def metrics(checked: DataFrame, result: str = "r") -> DataFrame:
    """One row: valid and invalid rows, warnings, and the share of invalid ones in percent."""
    n = lambda cond: F.coalesce(F.sum(cond.cast("long")), F.lit(0))
    r = F.col(result)
    one = checked.agg(n(r["valid"]).alias("n_valid"), n(~r["valid"]).alias("n_invalid"), n(has_warnings(r)).alias("n_warned"))
    return one.withColumn("invalid_rate", rounded(rate(F.col("n_invalid"), F.col("n_valid"))))
