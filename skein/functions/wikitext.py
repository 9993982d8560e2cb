"""Wiki markup to Markdown: a small parser, and its column functions over Arrow batches.

The parser reads templates, wiki links, external links and headings with a stack, so nested
``{{}}`` and ``[[]]`` are taken whole.  Links resolve through redirects by one exact step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of links that aren't articles.
SPECIAL = ("File:", "Image:", "Category:")
#: What emphasis, items and blank lines become in Markdown, and what is left of markup in an infobox value, each in the order of use,
#: as (what every match has, pattern, replacement).
MARKDOWN = (("'''", re.compile("'''(.+?)'''"), r"**\1**"), ("''", re.compile("''(.+?)''"), r"*\1*"), ("* ", re.compile(r"(?m)^\* "), "- "), ("\n\n\n", re.compile(r"\n{3,}"), "\n\n"))
VALUE = (("'''", re.compile("'''(.+?)'''"), r"\1"), ("''", re.compile("''(.+?)''"), r"\1"), ("<br", re.compile(r"<br\s*/?>"), ", "), ("<", re.compile("<[^>]+>"), ""), ("", re.compile(r"\s+"), " "))
_OPEN = re.compile(r"\{\{|\}\}|\[\[|\]\]")
_HEADING = re.compile(r"^(={1,6})[ \t]*(.+?)[ \t]*\1[ \t]*$", re.M)
_EXTERNAL = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)[ \t]+([^\]\n]+)\]")


@lru_cache(maxsize=8)  # a page's template and link readers ask for the same text one after another
def _pairs(text: str) -> tuple[tuple[int, int, str], ...]:
    """Matched ``{{...}}`` and ``[[...]]`` as (start, end, kind), outer ones included, by start."""
    stack, out = [], []
    if "[[" not in text and "{{" not in text:
        return ()
    for m in _OPEN.finditer(text):
        mark = m.group()
        if mark in ("{{", "[["):
            stack.append((mark, m.start()))
            continue
        want = "{{" if mark == "}}" else "[["
        k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == want), None)
        if k is not None:
            out.append((stack[k][1], m.end(), want))
            del stack[k:]
    return tuple(sorted(out))


def outermost(text: str, kind: str) -> list[tuple[int, int]]:
    """Outermost spans of one kind, in order."""
    out: list[tuple[int, int]] = []
    for start, end, mark in _pairs(text):
        if mark == kind and (not out or start >= out[-1][1]):
            out.append((start, end))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join(kept) + text[at:]


def remove_special(text: str) -> str:
    """Text without templates and without file, image and category links."""
    text = _without(text, outermost(text, "{{"))
    return _without(text, [(a, b) for a, b in outermost(text, "[[") if text[a + 2 : b - 2].startswith(SPECIAL)])


def _link_parts(inner: str) -> tuple[str, str | None]:
    target, bar, display = inner.partition("|")
    return target.strip(), display if bar and display else None


def wiki_links(text: str | None) -> list[str]:
    """Distinct link targets in order, without files, images and categories."""
    spans = [text[a + 2 : b - 2] for a, b, kind in _pairs(text or "") if kind == "[["]
    targets = [_link_parts(s)[0] for s in spans]
    return list(dict.fromkeys(t for t in targets if not t.startswith(SPECIAL)))


def _replaced(text: str, table: tuple[tuple[str, re.Pattern, str], ...]) -> str:
    for mark, pattern, new in table:
        if mark in text:
            text = pattern.sub(new, text)
    return text


def _convert_links(text: str, redirects: dict[str, str]) -> str:
    out, at = [], 0
    for a, b in outermost(text, "[["):
        target, display = _link_parts(text[a + 2 : b - 2])
        target = redirects.get(target, target)
        out += [text[at:a], f"[{display or target}]({target})"]
        at = b
    return "".join(out) + text[at:]


def _before_links(text: str) -> str:
    text = remove_special(text)
    # numbered items first, so that converted level-1 headings aren't taken for them
    text = re.sub(r"^# ", "1. ", text, flags=re.M)
    return _HEADING.sub(lambda m: f"{'#' * len(m[1])} {m[2].strip()}", text)


def looked_up(text: str | None) -> list[str]:
    """Distinct titles that ``to_markdown`` and ``infobox`` look up among the redirects."""
    try:
        ready = _before_links(text or "")
        found = [_link_parts(ready[a + 2 : b - 2])[0] for a, b in outermost(ready, "[[")]
    except (ValueError, RecursionError, re.error):
        found = []
    box = _infobox(text)
    return list(dict.fromkeys([*found, *(t for p in box[1:] for t in wiki_links(_value(p)))] if box else found))


def to_markdown(text: str | None, redirects: dict[str, str] | None = None) -> str:
    """Markdown of a page's markup.

    Every heading is converted in its place, and level-1 headings stay headings.  Bullets and
    numbers convert at the start of a line and one level deep.
    """
    if not text:
        return ""
    text = _convert_links(_before_links(text), redirects or {})
    text = _EXTERNAL.sub(lambda m: f"[{m[2].strip()}]({m[1]})", text)
    return _replaced(text, MARKDOWN).strip()


def _parameters(inner: str) -> list[str]:
    """A template's parts, split at bars outside nested markup."""
    nested, parts, at, k, end = _pairs(inner), [], 0, 0, 0
    for m in re.finditer(r"\|", inner):
        while k < len(nested) and nested[k][0] <= m.start():
            end = max(end, nested[k][1])
            k += 1
        if m.start() >= end:
            parts.append(inner[at : m.start()])
            at = m.end()
    return [*parts, inner[at:]]


def _value(parameter: str) -> str:
    key, equals, value = parameter.partition("=")
    return (value if equals else key).strip()


def _infobox(text: str | None) -> list[str] | None:
    """Name and parameters of the first infobox template."""
    for a, b, kind in _pairs(text or ""):
        if kind == "{{" and text[a + 2 : b - 2].lstrip()[: len("infobox")].lower() == "infobox":
            return _parameters(text[a + 2 : b - 2])
    return None


def _plain(value: str) -> str:
    """A parameter's text: link texts, no files, templates, emphasis or tags; line breaks as commas."""
    out, at = [], 0
    for a, b in outermost(value, "[["):
        target, display = _link_parts(value[a + 2 : b - 2])
        out += [value[at:a], "" if target.startswith(SPECIAL[:2]) else (display or target).strip()]
        at = b
    value = "".join(out) + value[at:]
    return _replaced(_without(value, outermost(value, "{{")), VALUE).strip()


def infobox(text: str | None, redirects: dict[str, str] | None = None) -> tuple[str | None, list[str]]:
    """Markdown of the first infobox template and its distinct links; (None, []) where there is none."""
    box = _infobox(text)
    if box is None:
        return None, []
    label = box[0].strip()[len("infobox") :].strip().title()
    lines, links, number = [f"## Infobox: {label}" if label else "## Infobox", ""], [], 0
    for p in box[1:]:
        key, value = p.partition("=")[0].strip(), _value(p)
        if "=" not in p:
            number += 1
            key = str(number)
        links += wiki_links(value)
        if value and key.lower() not in ("image", "image caption", "image_caption") and (shown := _plain(value)):
            lines.append(f"- **{key.replace('_', ' ').title()}**: {shown}")
    resolve = redirects or {}
    return "\n".join(lines), list(dict.fromkeys(resolve.get(t, t) for t in links))


def with_redirects(pages: DataFrame, redirects: DataFrame, key: str = "wiki_id") -> DataFrame:
    """``pages`` with the redirects (source, target) each looks up, as arrays ``_sources`` and ``_targets``; for tables of any size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [looked_up(t) for t in rows.column("text").to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column(key).take(at), pa.array([s for f in found for s in f], pa.string())], [key, "source"])

    links = pages.select(key, "text").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, source string")
    # a set, as pages with the same key look up the same titles
    found = links.join(redirects, "source").groupBy(key).agg(F.collect_set(F.struct("source", "target")).alias("_pairs"))
    found = found.select(key, F.col("_pairs.source").alias("_sources"), F.col("_pairs.target").alias("_targets"))
    return pages.join(found, key, "left")


def convert_pages(pages: DataFrame, redirects: dict[str, str] | None = None, raw: bool = True) -> DataFrame:
    """``pages`` (text column) with content, word_count, infobox, infobox_links and wiki_links; one pass.

    ``redirects`` is a map of bounded size; without it, pages may carry their own redirects in two
    array columns ``_sources`` and ``_targets`` (``with_redirects``).  A page whose markup can't be read keeps its raw text.
    Without ``raw`` the columns that stand for the markup (text, the two arrays, wiki_links) are left out and not made.
    """

    own = redirects is None and "_sources" in pages.columns
    kept = [f for f in pages.schema if raw or f.name not in ("text", "_sources", "_targets")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            maps = [{} if s is None else dict(zip(s, t)) for s, t in zip(rows.column("_sources").to_pylist(), rows.column("_targets").to_pylist())] if own else [redirects] * len(texts)
            contents, boxes = [], []
            for t, known in zip(texts, maps):
                try:
                    contents.append(to_markdown(t, known))
                except (ValueError, RecursionError, re.error):
                    contents.append(t)
                boxes.append(infobox(t, known))
            made = {
                "content": pa.array(contents, pa.string()), "word_count": pa.array([len((c or "").split()) for c in contents], pa.int32()),
                "infobox": pa.array([b[0] for b in boxes], pa.string()), "infobox_links": pa.array([b[1] for b in boxes], pa.list_(pa.string())),
            }
            if raw:
                made["wiki_links"] = pa.array([wiki_links(t) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), *made.values()], [*(f.name for f in kept), *made])

    new = "content string, word_count int, infobox string, infobox_links array<string>" + (", wiki_links array<string>" if raw else "")
    have = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pages.mapInArrow(run, have + new)


def html_to_markdown(html) -> "F.Column":
    """Markdown of simple html (headings, paragraphs, list items, links), as a column expression."""
    steps = [
        (r"(?s)<(script|style|head|nav|footer)\b[^>]*>.*?</\1>", ""), (r"(?s)<!--.*?-->", ""),
        (r"(?i)<h1[^>]*>", "\n\n# "), (r"(?i)<h2[^>]*>", "\n\n## "), (r"(?i)<h3[^>]*>", "\n\n### "), (r"(?i)<h4[^>]*>", "\n\n#### "), (r"(?i)</h[1-6]>", "\n\n"),
        (r"(?i)<li[^>]*>", "\n- "), (r"(?i)<(?:p|div|br)\b[^>]*>|</p>|</div>", "\n\n"),
        (r"""(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>""", "[$2]($1)"), (r"(?i)</?(?:b|strong)>", "**"), (r"(?i)</?(?:i|em)>", "*"),
        (r"<[^>]+>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
    ]
    for pattern, new in steps:
        html = F.regexp_replace(html, pattern, new)
    return html
