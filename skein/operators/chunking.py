"""Section-aware, token-bounded chunks of Markdown articles.

``chunk`` runs over Arrow batches of articles: its folds are order-dependent, and its token
counter may be a Python tokenizer.  ``sections``, ``pack`` and ``merge_small`` are the folds
as column expressions, for use in plans that need no tokenizer.  Nothing shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import text as T

MAX_TOKENS, MIN_TOKENS, HEADER_TOKENS = 500, 50, 10
HEADER = r"^(#{2,4})\s+(.+)$"
Counter = Callable[[Column], Column]
Count = Callable[[str], int]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(markdown: Column, title: Column) -> Column:
    """Array of (text, path, level) of an article.

    A deeper heading adds an entry to the path, one of the same level replaces the last, and
    a shallower one takes off as many more as the levels differ.  Text before the first
    heading has the path "Root"; an article without headings is one section named by its title.
    """
    state = "struct<level:int,path:array<string>,lines:array<string>,out:array<struct<text:string,path:string,level:int>>>"
    start = F.expr(f"cast(named_struct('level', 0, 'path', array(), 'lines', array(), 'out', array()) as {state})")

    def close(s: Column, last: bool) -> Column:
        body = _strip(F.array_join(s["lines"], "\n"))
        keep = (body != "") & (F.size(s["path"]) > 0) if last else body != ""
        path = F.when(F.size(s["path"]) > 0, F.array_join(s["path"], " > ")).otherwise("Root")
        one = F.struct(body.alias("text"), path.alias("path"), s["level"].alias("level"))
        return F.when(keep, F.concat(s["out"], F.array(one))).otherwise(s["out"])

    def step(s: Column, line: Column) -> Column:
        level = F.length(F.regexp_extract(line, HEADER, 1))
        name = F.array(_strip(F.regexp_extract(line, HEADER, 2)))
        keep = F.greatest(F.lit(0), F.when(level > s["level"], F.size(s["path"])).otherwise(F.size(s["path"]) - (s["level"] - level) - 1))
        path = F.when(F.size(s["path"]) == 0, name).otherwise(F.concat(F.slice(s["path"], F.lit(1), keep), name))
        head = F.struct(level.alias("level"), path.alias("path"), F.array(line).alias("lines"), close(s, False).alias("out"))
        more = F.struct(s["level"].alias("level"), s["path"].alias("path"), F.concat(s["lines"], F.array(line)).alias("lines"), s["out"].alias("out"))
        return F.when(level > 0, head).otherwise(more).cast(state)

    found = F.aggregate(F.split(markdown, "\n"), start, step, lambda s: close(s, True))
    whole = F.array(F.struct(markdown.alias("text"), title.alias("path"), F.lit(1).alias("level"))).cast("array<struct<text:string,path:string,level:int>>")
    # text without a heading anywhere leaves nothing (or one "Root" that no heading closed)
    return F.when(F.size(found) == 0, whole).otherwise(found)


def pack(sizes: Column, limit: int) -> Column:
    """Group numbers from 0 of a greedy packing: a group is closed when the next item would pass ``limit``."""
    start = F.expr("named_struct('sum', 0L, 'group', 0, 'out', cast(array() as array<int>))")

    def step(s: Column, n: Column) -> Column:
        new = (s["sum"] > 0) & (s["sum"] + n > limit)
        group = s["group"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, n).otherwise(s["sum"] + n).cast("long").alias("sum"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda n: n.cast("long")), start, step, lambda s: s["out"])


def merge_small(chunks: Column, least: int, count: Counter = T.token_estimate) -> Column:
    """Chunks (text, path) with those below ``least`` tokens put before the next one, which keeps its path.

    Merging cascades; the last chunk is never merged away.
    """
    state = "struct<carry:string,out:array<struct<text:string,path:string>>>"
    start = F.expr(f"cast(named_struct('carry', null, 'out', array()) as {state})")
    n = F.size(chunks)

    def step(s: Column, x: Column) -> Column:
        whole = F.when(s["carry"].isNotNull(), F.concat(s["carry"], F.lit("\n\n"), x["text"])).otherwise(x["text"])
        small = (count(whole) < least) & (x["i"] < n - 1)
        return F.struct(
            F.when(small, whole).alias("carry"),
            F.when(small, s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(whole.alias("text"), x["path"].alias("path"))))).alias("out"),
        ).cast(state)

    numbered = F.transform(chunks, lambda c, i: F.struct(c["text"].alias("text"), c["path"].alias("path"), i.alias("i")))
    return F.aggregate(numbered, start, step, lambda s: s["out"])


#: Sentence ends for the Python chunker; the same fixed pattern as the column function's.
_SENTENCE = re.compile(T.SENTENCE_END)
_HEADER = re.compile(HEADER)
_LINK = re.compile(T.LINK)


def estimate(text: str) -> int:
    """A quarter of the characters: the default counter."""
    return len(text) // 4


def links_in(text: str) -> list[str]:
    return list(dict.fromkeys(t for _, t in _LINK.findall(text) if not t.startswith(("http://", "https://", "#"))))


def sections_of(markdown: str, title: str) -> list[tuple[str, str]]:
    """(text, path) of an article's sections, by the rules of ``sections``."""
    path: list[str] = []
    level, lines, out = 0, [], []
    for line in [*markdown.split("\n"), None]:
        m = _HEADER.match(line) if line is not None else None
        if m or line is None:
            body = "\n".join(lines).strip()
            if body and (path or line is not None):
                out.append((body, " > ".join(path) or "Root"))
            if m is None:
                break
            deep = len(m[1])
            keep = len(path) if deep > level else max(0, len(path) - (level - deep) - 1)
            path, level, lines = [*path[:keep], m[2].strip()], deep, []
        lines.append(line)
    return out or [(markdown, title)]


def sentences_in(text: str) -> list[str]:
    """Sentences by the rules of ``skein.functions.text.sentences``."""
    for i, a in enumerate(T.ABBREVIATIONS):
        text = text.replace(a, chr(0xE000 + i))
    parts = _SENTENCE.split(text)
    for i, a in enumerate(T.ABBREVIATIONS):
        parts = [p.replace(chr(0xE000 + i), a) for p in parts]
    return [p.strip() for p in parts if p.strip()]


def split_section(text: str, count: Count = estimate, most: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[str]:
    """Texts of a section: itself if small, else packed paragraphs, with large paragraphs packed by sentences.

    The section's heading comes before every text.  A budget counts neither the heading nor
    separators; a single sentence over the budget stays whole; what a large paragraph leaves
    over joins the paragraphs after it.  Texts below ``least`` tokens join the next one.
    """
    if count(text) <= most:
        return [text]
    parts = [p for p in map(str.strip, re.split(r"\n\n+", text)) if p]
    header = ""
    if re.match(r"#{2,4}\s+.+", parts[0]):
        line, _, rest = parts[0].partition("\n")
        header, parts[0] = line + "\n\n", rest.strip()
    out: list[str] = []
    held: list[str] = []
    used = 0

    def flush(glue: str) -> None:
        nonlocal held, used
        if held:
            out.append(header + glue.join(held))
        held, used = [], 0

    for part in filter(None, parts):
        size = count(part)
        pieces, glue = [(part, size)], "\n\n"
        if size > most:
            flush("\n\n")
            pieces, glue = [(s, count(s)) for s in sentences_in(part)], " "
        for piece, n in pieces:
            if held and used + n > most:
                flush(glue)
            held.append(piece)
            used += n
    flush("\n\n")
    return [t for t, _ in merged([(t, []) for t in out], least, count)]


def merged(chunks: list[tuple[str, object]], least: int, count: Count = estimate) -> list[tuple[str, object]]:
    """Chunks (text, anything) with those below ``least`` tokens put before the next one, which keeps the rest."""
    out, carry = [], ""
    for i, (text, rest) in enumerate(chunks):
        text = carry + text
        if count(text) < least and i < len(chunks) - 1:
            carry = text + "\n\n"
        else:
            out.append((text, rest))
            carry = ""
    return out


def chunk_article(title: str, content: str, count: Count = estimate, most: int = MAX_TOKENS, least: int = MIN_TOKENS, header: int = HEADER_TOKENS) -> list[tuple[str, str]]:
    """(text, path) of an article's chunks."""
    flat = [(t, path) for body, path in sections_of(content, title) for t in split_section(body, count, most, least)]
    return merged(flat, header, count)


CHUNK_SCHEMA = "chunk_id string, wiki_page_id string, article_title string, section_path string, chunk_index int, chunk_text string, links array<string>, article_last_updated string"


#: Chunks that a task holds before it gives them on.
HELD = 1000


def chunk(articles: DataFrame, counter: Callable[[], Count] | None = None, most: int = MAX_TOKENS, least: int = MIN_TOKENS, header: int = HEADER_TOKENS) -> DataFrame:
    """Chunks (``CHUNK_SCHEMA``) of articles (wiki_id, title, content, and if present infobox, infobox_links, last_updated).

    An infobox is the first chunk, with the path "Infobox", and is never merged.  Articles with
    a blank title or text give no chunks.  ``counter`` makes a token counter in each task; the
    whole is one pass over the articles without a shuffle.
    """
    columns = [F.col(c).cast(t).alias(c) if c in articles.columns else F.lit(None).cast(t).alias(c) for c, t in (("wiki_id", "string"), ("title", "string"), ("content", "string"), ("infobox", "string"), ("infobox_links", "array<string>"), ("last_updated", "string"))]
    sound = articles.select(*columns).where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("content", F.lit(""))) != ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter() if counter else estimate
        kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
        schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in CHUNK_SCHEMA.split(", "))])

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for rows in batches:
            out = []
            for wiki_id, title, content, infobox, infobox_links, updated in zip(*(c.to_pylist() for c in rows.columns)):
                chunks = [(t, p, links_in(t)) for t, p in chunk_article(title, content, count, most, least, header)]
                if infobox:
                    chunks.insert(0, (infobox, "Infobox", infobox_links or []))
                out += [(f"{wiki_id}_{i}", wiki_id, title, p, i, t, links, updated) for i, (t, p, links) in enumerate(chunks)]
                if len(out) >= HELD:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    return sound.mapInArrow(run, CHUNK_SCHEMA)


def tokenizer_counter(path: str) -> Callable[[], Count]:
    """A counter that uses a ``tokenizers`` file."""

    def make() -> Count:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids) if text else 0

    return make


def register(spark) -> None:
    """The chunker as a table function for SQL: ``select * from skein_chunks(title, text)``, also with a lateral join."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_index int, section_path string, chunk_text string")
    class Chunks:
        def eval(self, title: str, text: str):
            if title and title.strip() and text and text.strip():
                for i, (body, path) in enumerate(chunk_article(title, text)):
                    yield i, path, body

    spark.udtf.register("skein_chunks", Chunks)
