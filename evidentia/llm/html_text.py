"""Main text of web pages: flat text blocks, judged by a small decision tree.

A page is cut into blocks at its block tags. Each block has its word count and
link density, those of the blocks before and after it, and one mark from the
tags around it: an article; none; a place for other things by its layout (a
class like ``sidebar`` or ``menu``); or other things themselves (navigation,
footers, asides, forms, classes like ``comments`` or ``cookie-notice``). An article
or main part resets what wrappers say of layout, and a form around it. A class counts as a whole:
all its words have to be such words, so ``ad-free`` and ``with-sidebar`` are
no marks. A decision tree, trained when the operator starts on the blocks of
the labelled pages below, tells main text from the rest: other things are out
at any length, words and links decide outside of articles, and within one runs
of short links among links are menus.

Spark deals out pages; a page is parsed whole in one pass, in linear time,
without a tree of elements. Defined results: a null or empty page has the
empty text; tags left open are closed by what follows them, end tags without a
start are passed over; markup that never ends runs to the end of the page;
repeated rows each get their row; an empty table gives no rows; extra columns
are passed on by ``extract`` unless they are called ``text`` or ``n_chars``.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped

#: Pages whose blocks are labelled: ``+n`` stands for a block of n words of main text, ``-n`` for one of others, ``@`` around either for a link.
LABELLED_PAGES = (
    # An article among menus, notices, comments and a footer, with short paragraphs, sources and a list of tags in it.
    "<header><div>-2</div><nav><ul><li>@-1@<li>@-2@<li>@-1@</ul></nav></header><div class='cookie-notice'>-36</div><div class='ad'>-12</div><article><header><h1>+9</h1></header><p>+60</p><p>+3</p><p>+120</p>"
    "<p>+35 @+7@</p><ul><li>@+5@<li>@+6@<li>@+8@</ul><p>+1</p><p>+40</p><div class='share-buttons'>@-1@</div><ul><li>@-1@<li>@-1@<li>@-2@<li>@-1@<li>@-1@</ul><section class='comments'><h2>-1</h2><p>-80</p><p>-14</p></section></article>"
    "<aside><h3>-2</h3><p>-120</p><p>-30</p></aside><form><p>-60</p><label>-1</label></form><footer>-12</footer>",
    # A short article with a linked headline; its page has a long footer and a form around all of it.
    "<form><nav>@-1@ @-1@</nav><div class='post-list sidebar'><p>@-4@</p></div><article class='post'><h1>@+9@</h1><p>+2</p><p>+14</p><p>+1</p></article><div class='related'><p>@-50@</p><p>-30</p></div></form><footer><p>-140</p><p>@-3@</p></footer>",
    "<main><h1>@+4@</h1><p>+25</p><p>@+30@</p><p>@+3@</p><p>+6</p></main><div id='comments'><p>-60</p><p>-110</p></div>",
    # Nothing is marked: links before and after, a heading, long and short paragraphs, a notice.
    "<div>@-1@</div><div>@-2@</div><div>@-3@</div><div>-3</div><h1>+7</h1><div>+90</div><div>+40 @+5@</div><div>+4</div><div>+60</div><div>+3</div><div>+25</div><div>@-5@</div><div>@-6@ -1</div><div>@-12@ -3</div><div>-5</div>",
    "<div>+80</div><ul><li>@-4@<li>@-5@<li>@-6@<li>@-5@</ul><div>@-55@</div><div>+55</div><ul><li>@-7@<li>@-9@<li>@-8@</ul><div>+20</div><div>@-20@</div><div>+110</div>",
    "<h2>+5</h2><p>+30</p><p>+18</p><p>+22 @+9@</p><p>+45</p><div>@-2@</div><div>-4</div><div>-2</div>",
    "<p>-2</p><p>-4</p><p>-3</p><p>@-30@ -3</p><p>-1</p>", "<p>+16</p>", "<p>+70</p><p>@-60@ -4</p>", "<p>@-15@ -7</p><p>@-1@</p>", "<p>-2</p>",
    # Layout names around main text and around other things.
    "<div class='sidebar'><p>@-3@</p><p>+50</p><p>+45</p><p>@-2@</p></div>", "<div class='menu'><p>-12</p><p>-4</p><p>@-40@</p></div>", "<div class='widget'><p>-8</p><p>-16</p><p>@-1@</p></div>",
    "<div class='sidebar'><p>+30</p><p>+90</p><p>+70 @+20@</p></div><div class='toolbar'>@-20@ -8</div><div class='navigation'>-10</div>",
    "<nav><p>-45</p></nav><aside><p>-75</p></aside><footer><p>-180</p></footer><form><p>-110</p></form><div class='newsletter'><p>-30</p></div><div class='advert'><p>-90</p></div>",
)
#: Tags that end a block.
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "label", "legend",
    "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
))
#: Tags of other things than the article.
OTHER = frozenset(("nav", "footer", "aside", "button", "select", "option", "fieldset", "dialog", "menu", "label", "legend"))
#: Words of class, id and role attributes for other things, at any place in a page.
THINGS = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promotion", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "comment", "comments", "disqus", "replies", "respond", "footer", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "contentinfo",
))
#: Words for the layout, which may also name a wrapper of the article.
LAYOUT = frozenset((
    "sidebar", "menu", "nav", "navbar", "navigation", "navigationmenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "toolbar", "search", "widget", "banner", "complementary",
))
#: Words that may stand beside them in one class.
BUILDING = frozenset((
    "site", "page", "main", "box", "block", "bar", "wrap", "wrapper", "container", "section", "area", "list", "item", "items", "form", "inner", "outer", "top", "bottom",
    "slot", "unit", "buttons", "button", "links", "link", "text", "body", "content", "title", "thread", "global", "primary", "secondary", "policy",
))
_ARTICLE_HINTS = frozenset(("article", "post", "entry", "story", "main"))
_OUTSIDE = ("", False, False, False, False)
_CLOSED_BY_SAME = frozenset(("li", "dt", "dd", "td", "th", "tr", "option"))
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|object|title|textarea)(?![a-z0-9-])[^>]*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    # Quotes count after "=" only, so a stray one opens nothing; values are read whole, at any length.
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)",
    re.S | re.I,
)
#: Each attribute with a value, or those of class, id and role as groups; other values are passed over whole.
_LABELS = re.compile(r"(?<![^\s/\"'])(?:(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>\"'][^\s>]*+))|[^\s/>=]++\s*+=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>\"'][^\s>]*+))", re.I)
_WORD = re.compile(r"[a-z]+")


def _marks(attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether class, id and role name other things, a part of the layout, an article, a header."""
    things = places = articles = header = False
    for found in _LABELS.findall(attributes):
        for token in "".join(found).lower().split():
            words = set(_WORD.findall(token))
            if words & THINGS and words <= THINGS | LAYOUT | BUILDING:
                things = True
            elif words & LAYOUT and words <= LAYOUT | BUILDING:
                places = True
            articles = articles or bool(words & _ARTICLE_HINTS)
            header = header or words == {"header"} or ("header" in words and words <= BUILDING | {"header"})
    return things, places, articles, header


@dataclass(frozen=True)
class Block:
    text: str
    words: int
    link_density: float
    mark: int


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without markup."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag; within other things, a form, a layout part, an article
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    in_link, at = False, 0

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                _, other, form, layout, article = stack[-1] if stack else _OUTSIDE
                out.append(Block(text, n, min(1.0, len(" ".join(linked).split()) / n), -2 if other or form else -1 if layout else int(article)))
        parts.clear()
        linked.clear()

    def say(raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked.append(text)

    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in BLOCK:
            continue
        close()
        if m["end"]:
            # Only what is open is looked for: each step of the search closes an element.
            while open_tags[tag]:
                last = stack.pop()[0]
                open_tags[last] -= 1
                if last == tag:
                    break
            in_link = in_link and tag in ("p", "div")
            continue
        if stack and (stack[-1][0] == "p" or (tag in _CLOSED_BY_SAME and stack[-1][0] == tag)):
            open_tags[stack.pop()[0]] -= 1
        if tag == "hr":
            continue
        _, other, form, layout, article = stack[-1] if stack else _OUTSIDE
        things, places, articles, header = _marks(m["attributes"]) if "=" in m["attributes"] else (False, False, False, False)
        inner = tag in ("article", "main")
        if inner and not article:
            form = layout = False  # these may be around a whole page
        root = tag in ("html", "body")
        other = other or tag in OTHER or (things and not root)
        form = form or tag == "form"
        layout = layout or (places and not root and tag != "main") or ((tag == "header" or header) and not article and not articles)
        article = article or inner or (tag in ("div", "section") and articles)
        stack.append((tag, other, form, layout, article))
        open_tags[tag] += 1
    say(page[at:])
    close()
    return out


def labelled(pages: tuple[str, ...] = LABELLED_PAGES) -> list[tuple[float, ...]]:
    """Features of the labelled pages' blocks, then 1 for main text."""
    rows = []
    for page in pages:
        linked = re.sub(r"@([^@]*)@", r"<a href=x>\1</a>", page)
        found = blocks(re.sub(r"([+-])(\d+)", lambda m: " ".join([f"{m[1]}w"] * int(m[2])), linked))
        rows += [(*f, float(b.text[0] == "+")) for f, b in zip(_features(found), found, strict=True)]
    return rows


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure or ``depth`` is reached."""

    def __init__(self, rows: list[tuple[float, ...]] | None = None, depth: int = 8):
        table = np.array(rows or labelled(), dtype=float)
        self.root = self._grow(table[:, :-1], table[:, -1], depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        share = y.mean()
        if depth == 0 or share in (0.0, 1.0):
            return bool(share >= 0.5)
        best = None
        for feature in range(x.shape[1]):
            values = np.unique(x[:, feature])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, feature] <= cut
                p, q = y[left].mean(), y[~left].mean()
                impurity = left.mean() * p * (1 - p) + (1 - left.mean()) * q * (1 - q)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, feature, float(cut), left)
        if best is None:
            return bool(share >= 0.5)
        _, feature, cut, left = best
        return feature, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def accepts(self, features: tuple[float, ...]) -> bool:
        node = self.root
        while not isinstance(node, bool):
            node = node[2] if features[node[0]] <= node[1] else node[3]
        return node


def _features(found: list[Block]) -> list[tuple[float, ...]]:
    """Words and link density of each block, of the one before and the one after it (0, 0 at the ends), and its mark."""
    sizes = [(0, 0.0), *((b.words, b.link_density) for b in found), (0, 0.0)]
    return [(*sizes[i + 1], *sizes[i], *sizes[i + 2], b.mark) for i, b in enumerate(found)]


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, f in zip(found, _features(found), strict=True) if tree.accepts(f))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column``, and ``text`` and ``n_chars`` of each page."""
    kept = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema if f.name in kept), "text string", "n_chars long"])
    tree = Tree()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column(len(kept))]
            arrays = [*(batch.column(i) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "text", "n_chars"])

    return mapped(pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`")), apply, schema)
