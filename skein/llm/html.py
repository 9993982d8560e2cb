"""Main text of web pages by a tree-structured graphical model.

Method: a page's elements form a tree, and each is content or not.  Every element has an
evidence term from its features (tag, words of its class, id and role, its text, its links), and
every parent-child pair a potential; sum-product messages go from the leaves to the root and
back, which gives each element's marginal.  Text of elements whose marginal is at least one
half is kept, block by block.  The weights are trained on labelled pages: the exact gradient
of the likelihood, with the same messages.

Elements of one Arrow batch are one forest, and messages run level by level in numpy over all
pages of the batch at once, so deep pages need no recursion.  Elements nested deeper than ``MOST_DEPTH``
are taken as siblings, as browsers do, so no page makes its batch slow.

Labelled pages come from ``labelled_pages``: pages of many layouts, made by a seeded
generator, each with the truth for every element.  Most of their class names say nothing or
aren't among the words that are features, so that structure (how much of a page's text an element has, its
links, its place in the tree) must be learned, and not a list of words.

Text rules: character references are decoded; white space inside a block becomes one space;
blocks are trimmed and joined by one line feed in page order; nothing else is dropped or
capped.  Markup, comments, scripts, styles and the head are never text.

Defined cases: null or empty html gives an empty text; html without tags is one block of
text and kept; unclosed and stray tags are read as browsers do in the common cases (a new
block closes an open paragraph, items and cells close their kind); text in ``svg``, ``template``, ``textarea`` and ``iframe`` isn't
page text, where their end tag is missing or they close themselves the page goes on; a script or style without an end
takes the rest of the page; repeated rows are treated alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import map_arrow

#: Fixed lists of HTML: elements without content, with raw text, and those that break a line of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("textarea title template iframe svg".split())
#: Nesting beyond this is flat, as in browsers.
MOST_DEPTH = 512
BLOCK = frozenset(
    "html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul center select option button".split()
)
#: What a new element closes: the open element it ends, and the elements that shield it.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, set()),
}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+")

TAGS = "html head body div p ul ol li h1 h2 h3 h4 h5 h6 article main section nav header footer aside form button select option table tr td th thead tbody blockquote pre figure figcaption dl dt dd details span a label address dialog menu".split()
HINTS = {
    "good": "article content post entry main story text body prose page hentry".split(),
    "menu": "nav navbar menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split(),
    "frame": "header footer masthead topbar bottom copyright legal colophon site logo brand".split(),
    "side": "sidebar aside rail widget related recommended popular trending more teaser tags".split(),
    "ad": "ad ads advert adverts advertisement banner sponsor sponsored promo promoted dfp outbrain taboola".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search paywall".split(),
    "social": "share sharing social follow facebook twitter likes".split(),
    "comment": "comment comments reply replies discussion disqus respond".split(),
    "meta": "byline author date timestamp meta caption".split(),
    "hidden": "hidden hide none collapsed".split(),
}
_HINT_OF = {w: i for i, ws in enumerate(HINTS.values()) for w in ws}
#: Features of the elements that only hold others, which are never content themselves.
_FRAMES = [1 + TAGS.index("html"), 1 + TAGS.index("body")]
N_FEATURES = 1 + len(TAGS) + 1 + len(HINTS) + 13


@dataclass
class Page:
    """A page's elements (parent, tag, hints) and its text pieces (element, block, text, whether in a link)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    hints: list[frozenset[int]] = field(default_factory=lambda: [frozenset()])
    label: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, int, str, bool]] = field(default_factory=list)


class _Open:
    """The open elements: (tag, element, in a link), with the places of each tag, so that every question takes constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, bool]] = [("html", 0, False)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, element: int, link: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, element, link))

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``; 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def close(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()


def parse(source: str) -> Page:
    """Elements and text pieces of an html text."""
    page, open_, block = Page(), _Open(), 0
    at, size, more_comments, in_head = 0, len(source), True, False
    loose: dict[str, int] = {}
    deep = [0]
    endless: set[str] = set()  # tags whose end tag isn't found any more

    def text(raw: str) -> None:
        if raw and not in_head:
            owner = open_.stack[-1][1]
            if page.tag[owner] in ("html", "body") and not raw.isspace():  # loose text is a paragraph of its own
                if loose.get("block") != block:
                    add(owner, "p", frozenset())
                    loose.update(block=block, element=len(page.parent) - 1)
                owner = loose["element"]
            page.pieces.append((owner, block, entities.unescape(raw) if "&" in raw else raw, open_.stack[-1][2]))

    def add(parent: int, tag: str, hints: frozenset[int]) -> None:
        if deep[parent] >= MOST_DEPTH:
            parent = page.parent[parent]
        deep.append(deep[parent] + 1)
        page.parent.append(parent)
        page.tag.append(tag)
        page.hints.append(hints)
        page.label.append(0)

    def end_of(tag: str, start: int) -> int:
        """Where the element's end tag ends; -1 if there is none."""
        found = None if tag in endless else _END[tag].search(source, start)
        if not found:
            endless.add(tag)
        return found.end() if found else -1

    while at < size:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        text(source[at:lt])
        if source.startswith("<!--", lt) and more_comments:
            end = source.find("-->", lt + 4)
            more_comments = end >= 0
            at = end + 3 if end >= 0 else size
            continue
        if source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = end + 1 if end >= 0 else size
            continue
        m = _TAG.match(source, lt) or _LOOSE.match(source, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in BLOCK or tag in ("html", "head", "body"):
            block += 1
        if m[1]:  # an end tag closes up to its start; an inline one not past a block
            in_head = in_head and tag != "head"
            place = open_.last(tag)
            if place and (tag in BLOCK or place > open_.block()):
                open_.close(place)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW or tag in SKIPPED:
            end = at if tag == "svg" and m[3].endswith("/") else end_of(tag, at)
            at = end if end >= 0 else size if tag in RAW else at
            continue
        if tag in VOID or tag == "html":
            if tag in ("img", "hr", "input"):
                text(" ")
            continue
        if tag == "head":
            in_head = True
            continue
        if tag in BLOCK or tag == "body":
            in_head = False
            if (p := open_.last("p")) and p == open_.block():  # a new block ends an open paragraph
                open_.close(p)
        if tag in _CLOSES:
            ends, shields = _CLOSES[tag]
            if (place := max(map(open_.last, ends))) > max(map(open_.last, shields), default=0):
                open_.close(place)
        attributes = m[3]
        hints: frozenset[int] = frozenset()
        if attributes and not attributes.isspace():
            found = _ATTRIBUTE.findall(attributes)
            hints = frozenset(_HINT_OF[w] for a in found for w in ({"hidden"} if "hidden" in a[0].lower() and "false" not in a[1] else _WORDS.findall("".join(a[1:]).lower())) if w in _HINT_OF)
        _, owner, link = open_.stack[-1]
        if tag in BLOCK or tag == "body" or hints:
            add(owner, tag, hints)
            owner = len(page.parent) - 1
        open_.push(tag, owner, link or tag == "a")
    return page


_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW | SKIPPED}


def by_level(level: np.ndarray) -> list[np.ndarray]:
    """The elements of each level, from one stable sort."""
    order = np.argsort(level, kind="stable")
    return np.split(order, np.searchsorted(level[order], np.arange(1, int(level.max(initial=0)) + 1)))


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all pages as one forest: parents (-1 for roots), levels, features, first element of each page."""
    sizes = [len(p.parent) for p in pages]
    first = np.cumsum([0, *sizes])
    parent = np.concatenate([np.where((a := np.array(p.parent)) < 0, -1, a + f) for p, f in zip(pages, first)]) if pages else np.zeros(0, int)
    n = int(first[-1])
    level = np.zeros(n, int)
    for p, f in zip(pages, first.tolist()):
        deep = [0] * len(p.parent)
        for i, up in enumerate(p.parent[1:], 1):
            deep[i] = deep[up] + 1
        level[f : f + len(deep)] = deep
    own = np.zeros((n, 3))
    for p, f in zip(pages, first.tolist()):
        for element, _, text, link in p.pieces:
            k = len(text) - text.count(" ")
            own[f + element] += (k, k * link, text.count(".") + text.count(",") + text.count("?"))
    whole = own.copy()
    for at in by_level(level)[:0:-1]:
        np.add.at(whole, parent[at], whole[at])
    x = np.zeros((n, N_FEATURES), np.float64)
    x[:, 0] = 1
    number = {t: i for i, t in enumerate(TAGS)}
    tags = np.array([number.get(t, len(TAGS)) for p in pages for t in p.tag], int)
    x[np.arange(n), 1 + tags] = 1
    at = 2 + len(TAGS)
    for i, hints in enumerate(h for p in pages for h in p.hints):
        for h in hints:
            x[i, at + h] = 1
    at += len(HINTS)
    share = whole[:, 1] / np.maximum(1, whole[:, 0])
    text = whole[:, 0]
    root = np.repeat(first[:-1], sizes)
    of_page = text / np.maximum(1, text[root])
    largest = np.zeros(n)  # the most text of a child of each element
    np.maximum.at(largest, parent[parent >= 0], text[parent >= 0])
    of_sibling = np.where(parent >= 0, text / np.maximum(1, largest[parent]), 1.0)
    x[:, at : at + 13] = np.stack([
        share, share > 0.6, np.log1p(text) / 8, np.log1p(own[:, 0]) / 8, own[:, 0] > 80, np.minimum(own[:, 2], 5) / 5, (own[:, 0] > 0) & (own[:, 0] < 25), text == 0,
        of_page, of_page < 0.05, of_page > 0.4, of_sibling, of_sibling < 0.2,
    ], axis=1)
    return parent, level, x, first


@dataclass
class Model:
    """Weights of the evidence, and the potentials of (parent, child) states."""

    weight: np.ndarray
    pair: np.ndarray


def marginals(model: Model, parent: np.ndarray, level: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product: each element's marginals (n, 2), and those of each element with its parent (n, 2, 2)."""
    n = len(parent)
    evidence = np.stack([np.zeros(n), x @ model.weight - 30 * x[:, _FRAMES].sum(axis=1)], axis=1)
    potential = np.exp(model.pair)
    up = np.zeros((n, 2))  # log of the message to the parent
    below = evidence.copy()
    rows = by_level(level)
    for at in rows[:0:-1]:
        top = below[at].max(axis=1, keepdims=True)
        up[at] = np.log(np.exp(below[at] - top) @ potential.T) + top
        np.add.at(below, parent[at], up[at])
    belief = below.copy()
    joint = np.zeros((n, 2, 2))
    for at in rows[1:]:
        rest = belief[parent[at]] - up[at]  # all that the parent hears elsewhere
        both = rest[:, :, None] + model.pair[None] + below[at][:, None, :]
        both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
        joint[at] = both / both.sum(axis=(1, 2), keepdims=True)
        down = joint[at].sum(axis=1)
        belief[at] = np.log(np.maximum(down, 1e-300))
    out = np.exp(belief - belief.max(axis=1, keepdims=True))
    return out / out.sum(axis=1, keepdims=True), joint


def train(pages: list[Page], rounds: int = 250, rate: float = 0.3, l2: float = 1e-5) -> Model:
    """Maximum likelihood on labelled pages by gradient steps (Adam), with exact marginals."""
    parent, level, x, _ = features(pages)
    y = np.array([v for p in pages for v in p.label])
    child = parent >= 0
    model = Model(np.zeros(N_FEATURES), np.zeros((2, 2)))
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1)
    first, second = np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)
    for t in range(1, rounds + 1):
        belief, joint = marginals(model, parent, level, x)
        grad = np.concatenate([x.T @ (belief[:, 1] - y), (joint[child].sum(axis=0) - seen).ravel()]) / len(y)
        grad += l2 * np.concatenate([model.weight, model.pair.ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-9)
        model = Model(model.weight - step[:N_FEATURES], model.pair - step[N_FEATURES:].reshape(2, 2))
    return model


def _prose(r: random.Random, least: int, most: int) -> str:
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    text = " ".join(word() + r.choice(["", "", "", ",", "", "", "", ""]) for _ in range(r.randint(least, most)))
    return text.capitalize() + "."


#: Class names of the generator that aren't features: some fit a kind, the rest any.
NAMES = {
    "good": "blog single news detail document reader write-up page-main".split(), "menu": "links top-list primary categories jump steps".split(), "frame": "top end brandbar base band strip".split(),
    "side": "column secondary extra box2 more-to-read picks".split(), "ad": "deal partner offer slot unit leaderboard skyscraper buy".split(), "notice": "message info-bar toast bar hint privacy".split(),
    "social": "buttons spread like-us channels".split(), "comment": "responses feedback opinions talk voices".split(),
}
ANY = "box block wrap row col inner item c1 x3f css-1q2w unit-a s-9 container section-b l-grid".split()


def labelled_pages(n: int = 900, seed: int = 3, hinted: float = 0.4) -> list[Page]:
    """Pages of many layouts with the truth for each element, by a seeded generator.

    Children of content are content, and of other parts aren't.  A share ``hinted`` of class names
    are words of ``HINTS``; others are of ``NAMES`` or say nothing.
    """
    r = random.Random(seed)

    def name(kind: str) -> str:
        return r.choice(HINTS[kind] if (v := r.random()) < hinted else NAMES[kind] if v < hinted + (1 - hinted) / 2 else ANY)
    link = lambda: f'<a href="/{r.randint(1, 99)}">{_prose(r, 1, 4)[:-1]}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>"

    def menu() -> str:
        return r.choice([f"<nav>{links(r.randint(3, 9))}</nav>", f'<div class="{name("menu")}">{links(r.randint(3, 8))}</div>', f'<ul class="{name("menu")}">' + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>", f'<div id="{name("menu")}">{" | ".join(link() for _ in range(5))}</div>'])

    def junk() -> str:
        kind = r.choice(["ad", "side", "notice", "social", "frame"])
        tag = r.choice(["div", "aside", "section", "div", "form", "p", "span"] if kind != "frame" else ["header", "footer", "div"])
        inner = r.choice([_prose(r, 1, 4), _prose(r, 4, 30), f"<p>{_prose(r, 1, 4)}</p>", links(4), f"<p>{_prose(r, 4, 40)}</p>", f"<h3>{_prose(r, 1, 4)}</h3>{links(3)}", f"<p>{_prose(r, 3, 12)}</p><button>{_prose(r, 1, 2)}</button>"])
        attribute = f' {r.choice(["class", "id"])}="{name(kind)}"' if tag not in ("aside", "footer", "header", "form") or r.random() < 0.5 else ""
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def comments() -> str:
        one = lambda: r.choice([f"<p>{_prose(r, 5, 40)}</p>", f'<div class="{name("comment")}"><p>{_prose(r, 5, 40)}</p></div>', f"<li><p>{_prose(r, 5, 40)}</p></li>"])
        tag = r.choice(["section", "div", "ol", "aside"])
        return f'<{tag} {r.choice(["class", "id"])}="{name("comment")}"><h3>{_prose(r, 1, 3)}</h3>{"".join(one() for _ in range(r.randint(1, 4)))}</{tag}>'

    def body() -> str:
        parts = [f"<h1>{_prose(r, 2, 9)}</h1>"] if r.random() < 0.9 else []
        if brief := r.random() < 0.25:  # a short article is content all the same
            parts.append(r.choice([f"<p>{_prose(r, 2, 9)}</p>", f"<p><b>{_prose(r, 2, 9)}<br></p>", f"<p>{_prose(r, 2, 9)}</p><p>{_prose(r, 1, 9)}</p>"]))
        for _ in range(0 if brief else r.randint(1, 9)):
            kind = r.random()
            inline = lambda k: re.sub(r" (\w+) ", lambda m: r.choice([f" <a href='/x'>{m[1]}</a> ", f" <b>{m[1]}</b> "]) if r.random() < 0.06 else m[0], _prose(r, *k))
            if kind < 0.58:
                parts.append(f"<p>{inline(r.choice([(1, 4), (8, 30), (20, 120), (60, 200)]))}</p>")
            elif kind < 0.66:
                parts.append(f"<h{(h := r.randint(2, 4))}>{_prose(r, 1, 6)}</h{h}>")
            elif kind < 0.8:
                tag, long = r.choice(["ul", "ol"]), r.choice([(1, 2), (1, 4), (2, 16)])
                parts.append(f"<{tag}>" + "".join(f"<li>{inline(long)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif kind < 0.84:
                parts.append(f"<blockquote><p>{_prose(r, 6, 40)}</p></blockquote>")
            elif kind < 0.88:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{_prose(r, 1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.91:
                parts.append(f"<pre>{_prose(r, 4, 20)}</pre>")
            elif kind < 0.94:
                parts.append(f"<figure><img src=x><figcaption>{_prose(r, 2, 10)}</figcaption></figure>")
            elif kind < 0.97:
                parts.append(f"<p><b>{_prose(r, 2, 9)}<br><p>{_prose(r, 8, 60)}</p>")
            else:
                parts.append(f"<div>{_prose(r, 10, 60)}</div>")
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            parts.insert(r.randint(0, len(parts)), "\x01" + r.choice([junk, junk, comments])() + "\x02")
        return "".join(parts)

    pages = []
    for i in range(n):
        inner = body()
        wrap = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="%s">{}</div>' % name("good"), '<div id="%s">{}</div>' % name("good"), '<div><div class="%s">{}</div></div>' % name("good"), '<section class="%s">{}</section>' % name("good"), "<div>{}</div>", "{}"])
        before = "".join(r.choice([menu, junk, menu, lambda: f"<header><p>{_prose(r, 1, 5)}</p>{menu()}</header>", lambda: f"<header><h1>{_prose(r, 1, 4)}</h1>{r.choice([menu(), ''])}</header>"])() for _ in range(r.randint(0, 3)))
        after = "".join(r.choice([menu, junk, comments, lambda: f"<footer>&copy; {_prose(r, 2, 20)}</footer>", lambda: f"<footer><p>{_prose(r, 2, 20)}</p></footer>"])() for _ in range(r.randint(0, 4)))
        source = f"<html><head><title>{_prose(r, 2, 6)}</title></head><body>{before}\x03{wrap.format(inner)}\x04{after}</body></html>"
        pages.append(_labelled(source))
    return pages


def _labelled(source: str) -> Page:
    """Parse a generated page; an element is content if its text (or its descendants') is all between the content marks."""
    page = parse(source)
    inside = junk = False
    good, bad = [0] * len(page.parent), [0] * len(page.parent)
    for element, _, text, _ in page.pieces:
        for part in re.split("([\x01-\x04])", text):
            if part in ("\x03", "\x04"):
                inside = part == "\x03"
            elif part in ("\x01", "\x02"):
                junk = part == "\x01"
            elif part.strip():
                (good if inside and not junk else bad)[element] += 1
    for i in range(len(page.parent) - 1, 0, -1):
        own = good[i] or bad[i]
        page.label[i] = int(good[i] > 0 and (good[i] >= bad[i] or own == good[i]))
        if page.tag[i] not in ("body", "html"):
            good[page.parent[i]] += good[i] > 0
            bad[page.parent[i]] += bad[i] > 0 and not good[i]
    page.pieces = [(e, b, re.sub("[\x01-\x04]", "", t), k) for e, b, t, k in page.pieces]
    for i, tag in enumerate(page.tag):
        if tag in ("body", "html"):
            page.label[i] = 0
    return page


@functools.cache
def default_model() -> Model:
    return train(labelled_pages())


def extract(sources: list[str | None], model: Model, threshold: float = 0.5) -> list[str]:
    """The main text of each page."""
    pages = [parse(s or "") for s in sources]
    parent, level, x, first = features(pages)
    content = marginals(model, parent, level, x)[0][:, 1] >= threshold
    out = []
    for page, source, f in zip(pages, (s or "" for s in sources), first.tolist()):
        plain = len(page.parent) == 2 and page.tag[1] == "p" and "<" not in source  # no markup: all of it is text
        blocks: dict[int, list[str]] = {}
        for element, block, text, _ in page.pieces:
            if plain or content[f + element]:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join("".join(b).split()) for b in blocks.values())
        out.append("\n".join(line for line in lines if line))
    return out


def main_text(pages: DataFrame, model: Model | None = None, id_column: str = "page_id") -> DataFrame:
    """``(id, url, text, n_chars)`` for every row of ``pages`` (id, url, html), without a shuffle."""
    model = model or default_model()

    def run(rows: dict) -> dict:
        texts = extract(rows["html"], model)
        return {id_column: rows["id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    kind = pages.schema[id_column].dataType.simpleString()
    return map_arrow(pages.selectExpr(f"`{id_column}` id", "cast(url as string) url", "cast(html as string) html"), run, f"`{id_column}` {kind}, url string, text string, n_chars long")
