"""Main text of web pages by composite text density.

A page becomes a tree of elements, built with the end tags that HTML lets writers leave out.
Of every node are known its characters and tags, and those of its links. Characters per tag,
adjusted for links, is its density (a node of plain text counts far more than one of links,
measured against the share of links on the whole page):

    density = C / T * log(C / LC * T / LT) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e)

The densities of a node's children and of its own text are summed; the node with the largest
sum is the core of the article, and the least density on the way from ``body`` to it is the
threshold. Where an ``article`` or ``main`` stands around the core, its whole text is taken,
less lists of links under the threshold. Elsewhere each part of the page that reaches the
threshold gives its own subtree of largest sum, and the headings that stand before it.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known by
their element, role or class names and enter no sum; a part around the article is never
taken for one of them because of its class.

Character references are decoded once, white space becomes one space, and so do the borders
of blocks. Defined results: a null or empty page, or one without text, has the empty text;
repeated rows give a row each; null ids and urls stay null; of equal sums the first counts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.common import batches_by_size, keep_only

# fixed values: element names of HTML by what they do
VOID = frozenset({
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
})
RAW = frozenset({
    "script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes",
})
INLINE = frozenset({
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr",
})
ENDS_P = frozenset({
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre",
    "search", "section", "summary", "table", "ul",
})
#: an element that starts ends an open one of the second kind, unless one of the third stands between
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
CELLS = frozenset({"td", "th", "caption", "table", "template"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
ARTICLE = frozenset({"article", "main"})
UNSEEN = frozenset({
    "head", "script", "style", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "select", "textarea",
    "title", "datalist",
})
ASIDE = frozenset({
    "nav", "footer", "aside", "form", "menu", "dialog", "button", "input", "search", "fieldset",
})
ASIDE_ROLES = frozenset({
    "navigation", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form",
})
ASIDE_NAMES = frozenset({
    "nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "ad", "ads",
    "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "popup", "modal", "overlay", "newsletter",
    "subscribe", "subscription", "signup", "login", "searchbox", "comment", "comments", "commentlist", "disqus", "replies", "respond",
    "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager", "toolbar", "widget",
})
COMMENT_NAMES = frozenset({
    "comment", "comments", "commentlist", "disqus", "replies", "respond",
})
NEGATING = frozenset({
    "has", "with", "no", "without",
})

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The tree of a page in order of its start tags: node 0 is the page itself.

    ``parts`` holds ``(node, text)`` in page order, and None where a block begins or ends.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.attributes = ["#page"], [-1], [""]
        self.parts: list[tuple[int, str] | None] = []
        self._open, self._names = [0], Counter()
        self._read(source)

    def _text(self, text: str) -> None:
        if text:
            self.parts.append((self._open[-1], html.unescape(text) if "&" in text else text))

    def _end(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        for node in self._open[depth:]:
            self._names[self.tag[node]] -= 1
        del self._open[depth:]

    def _innermost(self, names, borders=frozenset()) -> int | None:
        """Depth of the innermost open element of ``names`` that no border hides."""
        if not any(self._names[n] > 0 for n in names):
            return None
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in names:
                return depth
            if tag in borders:
                return None
        return None

    def _outermost(self, names, borders) -> int | None:
        """Depth of the outermost of ``names`` inside the innermost border."""
        if not any(self._names[n] > 0 for n in names):
            return None
        found = None
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tag[self._open[depth]]
            if tag in borders:
                break
            if tag in names:
                found = depth
        return found

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ENDS_P and (depth := self._innermost({"p"}, CELLS)) is not None:
            self._end(depth)
        if tag in HEADINGS and self.tag[self._open[-1]] in HEADINGS:
            self._end(len(self._open) - 1)
        if tag in IMPLIED and (depth := self._outermost(*IMPLIED[tag])) is not None:
            self._end(depth)
        if tag == "a" and (depth := self._innermost({"a"}, CELLS)) is not None:
            self._end(depth)
        if tag not in INLINE:
            self.parts.append(None)
        if tag in ("html", "body") and self._names[tag]:
            return
        self.tag.append(tag)
        self.parent.append(self._open[-1])
        self.attributes.append(attributes)
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)
            self._names[tag] += 1

    def _stop(self, tag: str) -> None:
        if tag not in INLINE:
            self.parts.append(None)
        if tag in ("html", "body"):
            return  # what follows still belongs to the page
        names = HEADINGS if tag in HEADINGS else {tag}
        depth = self._innermost(names, frozenset() if tag in CELLS or tag in ("tr", "tbody", "thead", "tfoot") else CELLS)
        if depth is None or tag in INLINE and any(self.tag[x] not in INLINE for x in self._open[depth:]):
            return  # an inline end tag ends no block
        self._end(depth)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                self._text(source[at:])
                return
            found = _TAG.match(source, begin)
            if not found:
                other = _OTHER.match(source, begin)
                if other:
                    self._text(source[at:begin])
                    at = other.end()
                elif begin + 1 < size and source[begin + 1].isalpha() and source[begin + 1].isascii() and source.find(">", begin) < 0:
                    self._text(source[at:begin])
                    return  # cut off within a tag
                else:  # a lone sign
                    self._text(source[at : begin + 1])
                    at = begin + 1
                continue
            self._text(source[at:begin])
            at = found.end()
            close, tag, attributes = found[1], found[2].lower(), found[3]
            if close:
                self._stop(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                inside = source[at : end.start() if end else size]
                if inside and tag in ("textarea", "title"):
                    self._text(inside)
                at = end.end() if end else size
                self._stop(tag)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(raw)} if raw else {}


def _set_apart(page: Page) -> list[bool]:
    """Whether each node, by itself, is no part of an article."""
    n = len(page.tag)
    around, in_article = [False] * n, [False] * n
    names: list[frozenset] = [frozenset()] * n
    known: list[dict[str, str]] = [{}] * n
    for i in range(1, n):
        known[i] = _attributes(page.attributes[i])
        if "class" in known[i] or "id" in known[i]:
            own = {x.lower() for x in _NAME.findall(f"{known[i].get('class', '')} {known[i].get('id', '')}")}
            names[i] = frozenset() if own & NEGATING else frozenset(own & ASIDE_NAMES)
        in_article[i] = in_article[page.parent[i]] or page.tag[page.parent[i]] in ARTICLE
    for i in range(n - 1, 0, -1):
        article = page.tag[i] in ARTICLE and not names[i] & COMMENT_NAMES
        around[page.parent[i]] |= article or around[i]
    apart = [False] * n
    for i in range(1, n):
        tag, role = page.tag[i], known[i].get("role", "").lower()
        style = known[i].get("style", "")
        unseen = tag in UNSEEN or "hidden" in known[i] or known[i].get("aria-hidden", "").lower() == "true" or _UNSEEN_STYLE.search(style)
        named = names[i] & (COMMENT_NAMES if tag in ARTICLE else ASIDE_NAMES) and tag not in ("html", "body")
        head = (tag == "header" or role == "banner") and not in_article[i]
        apart[i] = bool(unseen or not around[i] and (tag in ASIDE or role in ASIDE_ROLES or named or head))
    return apart


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_share: float) -> float:
    """Composite text density of a node; ``page_share`` is the share of links in the page's text."""
    tags = max(tags, 1)
    plain = chars / tags
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + page_share * chars + math.e)
    if plain == 0 or base < 1 + 1e-9:
        return plain  # no links anywhere
    return plain * max(0.0, math.log(max(chars / max(link_chars, 1) * tags / max(link_tags, 1), 1e-9)) / math.log(base))


class Densities:
    """Sums over the subtrees of a page without its set-apart parts."""

    def __init__(self, page: Page, apart: list[bool]) -> None:
        n = len(page.tag)
        self.page, self.gone = page, list(apart)
        for i in range(1, n):
            self.gone[i] |= self.gone[page.parent[i]]
        own = [0] * n
        for part in page.parts:
            if part is not None and part[1]:
                own[part[0]] += _length(part[1])
        self.chars, self.tags, self.link_chars, self.link_tags = list(own), [0] * n, [0] * n, [0] * n
        whole, whole_links = sum(c for c, tag in zip(own, page.tag, strict=True) if tag not in UNSEEN), 0
        inside = [False] * n
        for i in range(1, n):
            inside[i] = inside[page.parent[i]] or page.tag[i] == "a"
            whole_links += own[i] * inside[i]
        share = whole_links / max(whole, 1)
        self.density, self.sum, self.best = [0.0] * n, [0.0] * n, list(range(n))
        for i in range(n - 1, -1, -1):
            if self.gone[i]:
                continue
            if page.tag[i] == "a":
                self.link_chars[i] = self.chars[i]
            self.density[i] = density(self.chars[i], self.tags[i], self.link_chars[i], self.link_tags[i], share)
            # the node's own text is summed like a child of its own
            self.sum[i] += density(own[i], 1, own[i] * inside[i], int(inside[i]), share)
            if self.sum[i] >= self.sum[self.best[i]]:  # children came before; of equal sums the outer one, which begins first
                self.best[i] = i
            up = page.parent[i]
            if up >= 0:
                self.sum[up] += self.density[i]
                self.chars[up] += self.chars[i]
                self.tags[up] += self.tags[i] + 1
                self.link_chars[up] += self.link_chars[i]
                self.link_tags[up] += self.link_tags[i] + (page.tag[i] == "a")
                if self.best[up] == up or self.sum[self.best[i]] >= self.sum[self.best[up]]:
                    self.best[up] = self.best[i]

    def way_up(self, i: int) -> list[int]:
        out = [i]
        while self.page.parent[out[-1]] >= 0:
            out.append(self.page.parent[out[-1]])
        return out


def chosen(page: Page, d: Densities) -> list[bool]:
    """Whether each node belongs to the article."""
    n, tag, parent = len(page.tag), page.tag, page.parent
    core = d.best[0]
    way = d.way_up(core)
    body = next((i for i in way if tag[i] == "body"), 0)
    least = min(d.density[i] for i in way[: way.index(body) + 1])
    links = [d.link_tags[i] > 1 and 2 * d.link_chars[i] > d.chars[i] and d.density[i] < least for i in range(n)]
    article = next((i for i in reversed(way) if tag[i] in ARTICLE), None)
    kept = [False] * n
    if article is not None:
        for i in range(article, n):
            kept[i] = not d.gone[i] and (i == article or kept[parent[i]] and not (links[i] and i not in way))
        return kept
    # every part that reaches the threshold gives its subtree of largest sum
    begins, met = set(), [False] * n
    for i in range(body, n):
        met[i] = not d.gone[i] and d.chars[i] > 0 and d.density[i] >= least and (i == body or met[parent[i]])
        if met[i]:
            begins.add(d.best[i])
    for i in range(body, n):
        kept[i] = not d.gone[i] and (i in begins or i != body and kept[parent[i]] and not (links[i] and i not in way))
    last = [False] * n  # whether something kept comes later under the same parent
    for i in range(n - 1, body, -1):
        if tag[i] in HEADINGS and not d.gone[i] and last[parent[i]]:
            kept[i] = True
        last[parent[i]] |= kept[i] or last[i]
    for i in range(body + 1, n):
        kept[i] = kept[i] or not d.gone[i] and tag[parent[i]] in HEADINGS and kept[parent[i]]
    return kept


def main_text(source: str | None) -> str:
    """The main text of one page."""
    page = Page(source or "")
    kept = chosen(page, Densities(page, _set_apart(page)))
    return " ".join("".join(" " if part is None else part[1] for part in page.parts if part is None or kept[part[0]]).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row."""
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        keep_only()
        for b in batches_by_size(batches, "html"):
            text = [main_text(x) for x in b.column("html").to_pylist()]
            arrays = [b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())]
            yield pa.record_batch(arrays, ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
