"""Column expressions on text: tokens, paragraphs, sentences, links, names, books, ids.

White space in patterns is Java's ASCII ``\\s``; empty tokens are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: An internal link ``[text](target)`` with one level of parentheses in the target.
LINK = r"\[([^\]]+)\]\(([^()]*(?:\([^()]*\)[^()]*)*)\)"
#: Source book patterns.
SOURCE_BOOKS = (
    r"Codex:\s*([^,.\n]+)",
    r"Index:\s*([^,.\n]+)",
    r"Horus Heresy:\s*Book\s+(\d+)[:\s]*([^,.\n]+)",
    r"Horus Heresy:\s*([^,.\n]+)",
    r"White Dwarf\s+(\d+)",
    r"Campaign Book:\s*([^,.\n]+)",
    r"Imperial Armour:\s*([^,.\n]+)",
    r"Codex Supplement:\s*([^,.\n]+)",
)
#: Abbreviations that end no sentence, and the boundary between sentences.
ABBREVIATIONS = ("Dr.", "Mr.", "Mrs.", "Ms.", "vs.", "etc.", "i.e.", "e.g.")
SENTENCE_END = r"""(?<=[.!?])(?<![A-Z]\.)(?<!\.\.\.)\s+(?=[A-Z"])"""


def tokens(text: Column, lowercase: bool = False) -> Column:
    """White-space tokens in order; lower-cased on demand, punctuation kept."""
    text = F.lower(text) if lowercase else text
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(tokens(text))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down: the default token counter."""
    return F.floor(F.length(text) / 4).cast("int")


def paragraphs(text: Column, separator: str = r"\n\n+") -> Column:
    """Trimmed, non-empty paragraphs."""
    return F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences; abbreviations, initials and dots of omission end none."""
    marks = [(a, f"{i}") for i, a in enumerate(ABBREVIATIONS)]
    shielded = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, text)
    restore = lambda s: reduce(lambda t, m: F.replace(t, F.lit(m[1]), F.lit(m[0])), marks, s)
    return F.filter(F.transform(F.split(shielded, SENTENCE_END), lambda s: F.regexp_replace(restore(s), r"^\s+|\s+$", "")), lambda s: s != "")


def links(text: Column) -> Column:
    """Distinct internal link targets in order of first mention; web addresses and anchors don't count."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(LINK), F.lit(2)), lambda t: ~t.rlike(r"^(https?://|#)")))


def wiki_links(text: Column) -> Column:
    """Distinct targets of ``[[target|text]]`` in order; files, images and categories don't count."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|]+)(?:\|[^\[\]]*)?\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike("^(File|Image|Category):")))


def _held(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _where_named(text: Column, marks: list[str], found: Column) -> Column:
    """``found`` (texts) where a text has one of the marks that every match begins with; elsewhere no pattern is tried, and there are none."""
    return F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in marks)), found).when(text.isNotNull(), F.expr("cast(array() as array<string>)"))


def character_names(text: Column, most: int = 5) -> Column:
    """The ``most`` frequent names in ``[[name|text]]``, ties by first mention.

    Mentions are sorted by name and place, so that a name's are side by side and counted by their
    bounds: the work grows with the mentions times their logarithm, not with their square.
    """
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"), F.lit(1))

    def ranked(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i)["n"] != F.get(s, i - 1)["n"]))
        one = lambda b, e: F.struct((b - e).alias("c"), F.get(s, b)["p"].alias("p"), F.get(s, b)["n"].alias("n"))
        return _held(begins, lambda bs: F.transform(bs, lambda b, j: one(b, F.coalesce(F.get(bs, j + 1), F.size(s)))))

    mentions = F.array_sort(F.transform(found, lambda n, i: F.struct(n.alias("n"), i.alias("p"))))
    names = F.transform(F.slice(F.array_sort(_held(mentions, ranked)), 1, most), lambda s: s["n"])
    return _where_named(text, ["[["], names)


def source_books(text: Column) -> Column:
    """Distinct source book titles in order of their characters; the groups of a pattern are joined by a space."""
    found = []
    for pattern in SOURCE_BOOKS:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g + 1)) for g in range(re.compile(pattern).groups)]
        found.append(groups[0] if len(groups) == 1 else F.zip_with(groups[0], groups[1], lambda a, b: F.concat_ws(" ", F.when(a != "", a), F.when(b != "", b))))
    trimmed = F.transform(F.concat(*found), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))
    titles = F.array_sort(F.array_distinct(F.filter(trimmed, lambda t: t != "")))
    return _where_named(text, sorted({re.match("[A-Za-z ]+", p)[0] for p in SOURCE_BOOKS}), titles)


def chunk_id(page_id: Column, index: Column) -> Column:
    return F.concat_ws("_", page_id.cast("string"), index.cast("string"))


def chunk_id_parts(chunk: Column) -> tuple[Column, Column]:
    """Page id and chunk index of a chunk id: split at the last underscore."""
    return F.regexp_extract(chunk, r"^(.*)_([^_]*)$", 1), F.regexp_extract(chunk, r"^(.*)_([^_]*)$", 2)


def preview(text: Column, most: int = 200) -> Column:
    """The first ``most`` characters, with dots where text was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def _title(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.title())


def ascii_fold(text: Column) -> Column:
    """Compatibility-decomposed text without its non-ASCII characters; Spark has no such function."""
    return F.pandas_udf(_fold, "string")(text)


def sanitize_filename(title: Column, most: int = 255) -> Column:
    """A file name for a title; null where nothing is left of it."""
    name = F.translate(ascii_fold(title), " /:", "_--")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9_-]", ""), "_+", "_"), "-+", "-")
    name = F.regexp_replace(name, "^[_-]+|[_-]+$", "")
    cut = F.regexp_replace(F.substring(name, 1, most), "[_-]+$", "")
    return F.nullif(F.when(F.length(name) > most, cut).otherwise(name), F.lit(""))


def title_case(text: Column) -> Column:
    """Upper case after every non-letter (unlike ``initcap``, which looks at white space only)."""
    return F.pandas_udf(_title, "string")(text)


def register(spark) -> None:
    """The Python-backed functions by name, for use in SQL."""
    spark.udf.register("skein_ascii_fold", F.pandas_udf(_fold, "string"))
    spark.udf.register("skein_title_case", F.pandas_udf(_title, "string"))
