"""Main text of web pages by composite text density.

A page is read into a tree of nodes.  Each node gets the number of characters and tags below it and, of these,
those inside links; its density is characters per tag, weighted by how little of them are links.  A
node's *sum* adds up the densities of its children: the node that directly holds the many dense
paragraphs of an article has the largest.  The least density on the way from that node to the body is the
threshold: other nodes that reach it, with the node of the largest sum below them, belong to the text too.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments are told
by their tags, roles and names and taken out of the tree before densities are worked out, because a short
foot line can be as dense as a paragraph.  A page that marks its article (``article``, ``main``) gives
the marked part that holds the node of the largest sum, whole: headings and short paragraphs
are not dropped for being short.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.common import slices

# Fixed values of HTML: elements without content, elements whose content is no markup, elements that are no block,
# elements of a page's head, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img
    script style noscript template""".split()
)
_OF_HEAD = frozenset("html head base link meta title script style noscript template".split())
_ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: Open elements that a start tag closes, and the elements beyond which it does not look.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
_BARRIERS = frozenset("table td th button object".split())

# What is not main text: tags, roles, and words of class and id names.
NOISE_TAGS = frozenset(
    "head title nav aside footer form menu dialog button select datalist textarea script style noscript template svg math canvas iframe object audio video map noembed noframes".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
NOISE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies copyright disclaimer disqus
    footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related
    replies reply respond rail search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets""".split()
)
#: Names that, inside an article, mark its own heading.
_HEADING_NAMES = frozenset({"header", "banner", "masthead"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"(=?[^\s/>=]*)(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_KEPT = frozenset({"class", "id", "role", "hidden", "style", "aria-hidden", "itemprop"})


class Page:
    """Nodes of a page in order: parent, tag, attributes that matter, and the runs of text (node, text).

    Runs are decoded; a space that belongs to node -1 stands where a block begins or ends.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes = [-1], [""], [{}]
        self.text: list[tuple[int, str]] = []
        self._open, self._many, self._once = [0], Counter(), set()
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            start = n if start < 0 else start
            if start > at:
                self.text.append((self._open[-1], references.unescape(source[at:start])))
            at = self._markup(source, start) if start < n else n

    def _markup(self, source: str, start: int) -> int:
        """Takes in the markup that begins at ``start``; the place after it."""

        if source.startswith("<!--", start):
            at_once = 4 if source.startswith(">", start + 4) else 5 if source.startswith("->", start + 4) else 0
            return start + at_once + 1 if at_once else _after(source, "-->", start + 4)
        closing = source.startswith("/", start + 1)
        name = _NAME.match(source, start + 1 + closing)
        if name is None:
            if closing or source.startswith(("!", "?"), start + 1):
                return _after(source, ">", start)
            self.text.append((self._open[-1], "<"))
            return start + 1
        end, found = _attributes(source, name.end())
        if end > len(source):  # the page ends within the tag
            return end
        tag = name[0].lower()
        if closing:
            self._end(tag)
            return end
        self._start(tag, found)
        if tag not in RAW:
            return end
        close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, end)
        return close.start() if close else len(source)

    def _start(self, tag: str, attributes: dict) -> None:
        if tag not in _OF_HEAD:
            self._close({"head"}, frozenset())
        if tag in _ENDS_PARAGRAPH:
            self._close({"p"}, _BARRIERS)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in ("html", "head", "body"):  # a page has one of each
            if tag in self._once:
                return
            self._once.add(tag)
        self.parent.append(self._open[-1])
        self.tag.append(tag)
        self.attributes.append(attributes)
        if tag not in INLINE:
            self.text.append((-1, " "))
        if tag not in VOID:
            self._open.append(len(self.tag) - 1)
            self._many[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or not self._many[tag]:  # what comes after a body's end still is part of the page
            return
        for k in range(len(self._open) - 1, 0, -1):
            here = self.tag[self._open[k]]
            if here == tag:
                return self._cut(k)
            if tag in INLINE and here not in INLINE or here in _BARRIERS and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                return None

    def _close(self, tags: set, beyond: set | frozenset) -> None:
        """Closes the open elements of these tags, and all within them, that lie below any element of ``beyond``."""

        if not any(self._many[t] for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            here = self.tag[self._open[k]]
            if here in tags:
                self._cut(k)
            elif here in beyond:
                return

    def _cut(self, k: int) -> None:
        for node in self._open[k:]:
            self._many[self.tag[node]] -= 1
            if self.tag[node] not in INLINE:
                self.text.append((-1, " "))
        del self._open[k:]


def _after(source: str, mark: str, start: int) -> int:
    at = source.find(mark, start)
    return len(source) if at < 0 else at + len(mark)


def _attributes(source: str, at: int) -> tuple[int, dict]:
    """The place after a tag's end, beyond the source if it has none, and those attributes that matter."""

    found: dict[str, str] = {}
    while True:
        at = _GAP.match(source, at).end()
        if at >= len(source):
            return len(source) + 1, found
        if source[at] == ">":
            return at + 1, found
        one = _ATTRIBUTE.match(source, at)
        name, value, at = one[1].lower(), "", one.end()
        if one[2]:
            quote = source[at : at + 1]
            if quote in ('"', "'"):
                stop = source.find(quote, at + 1)
                if stop < 0:
                    return len(source) + 1, found
                value, at = source[at + 1 : stop], stop + 1
            else:
                value = _VALUE.match(source, at)[0]
                at += len(value)
        if name in _KEPT:
            found.setdefault(name, references.unescape(value))


def _is_noise(tag: str, attributes: dict, in_article: bool) -> bool:
    """Whether an element by its own tag and names is no main text."""

    if tag in NOISE_TAGS or attributes.get("role", "").lower() in NOISE_ROLES:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main", "h1"):
        return False
    names = {w.lower() for w in _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}")} & NOISE_NAMES
    return bool(names - _HEADING_NAMES if in_article else names)


def _is_article(tag: str, attributes: dict) -> bool:
    return tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article") or attributes.get("itemprop") == "articleBody"


class Densities:
    """Characters, tags, densities and sums of a page's nodes, without what is no main text."""

    def __init__(self, page: Page):
        self.page = page
        n = len(page.tag)
        parent, tags = page.parent, page.tag
        self.body = next((k for k in range(n) if tags[k] == "body"), 0)
        article, inside = [False] * n, [False] * n
        noise = [False] * n
        for k in range(1, n):
            article[k] = _is_article(tags[k], page.attributes[k])
            inside[k] = inside[parent[k]] or article[k]
            noise[k] = _is_noise(tags[k], page.attributes[k], inside[parent[k]])
        within = list(noise)
        for k in range(1, n):
            within[k] |= within[parent[k]]
        anchors = [k for k in range(1, n) if not noise[k] and (article[k] or tags[k] == "h1")]
        if anchors and all(within[k] for k in anchors):
            # the article lies in a wrapper that is named for what it has beside it, or in a form around the page
            for k in self._path(next((k for k in anchors if tags[k] in ("h1", "main")), anchors[0])):
                noise[k] &= tags[k] not in ("form", "div", "section", "article", "td", "table")
        for k in range(1, n):
            noise[k] |= noise[parent[k]]
        self.noise, self.article = noise, article
        link = [False] * n
        for k in range(1, n):
            link[k] = link[parent[k]] or tags[k] == "a"
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in page.text:
            if node >= 0 and not noise[node]:
                size = sum(map(len, text.split()))
                self.chars[node] += size
                if link[node]:
                    self.link_chars[node] += size
        for k in range(n - 1, 0, -1):
            if not noise[k]:
                up = parent[k]
                self.chars[up] += self.chars[k]
                self.tags[up] += self.tags[k] + 1
                self.link_chars[up] += self.link_chars[k]
                self.link_tags[up] += self.link_tags[k] + (tags[k] == "a")
        self.density = [0.0 if noise[k] else self._density(k) for k in range(n)]
        self.sum = [0.0] * n
        for k in range(n - 1, 0, -1):
            self.sum[parent[k]] += self.density[k]

    def _density(self, k: int) -> float:
        """Characters per tag, by a logarithm whose base grows with the node's share of link characters."""

        chars, tags = self.chars[k], max(1, self.tags[k])
        if not chars:
            return 0.0
        linked, link_tags = max(1, self.link_chars[k]), max(1, self.link_tags[k])
        other = max(1, chars - self.link_chars[k])
        of_body = self.link_chars[self.body] / max(1, self.chars[self.body])
        base = math.log(chars / other * linked + of_body * chars + math.e)
        return chars / tags * math.log(max(1.0, chars / linked * tags / link_tags)) / math.log(base)

    def _path(self, k: int) -> list[int]:
        out = [k]
        while out[-1] > 0 and out[-1] != self.body:
            out.append(self.page.parent[out[-1]])
        return out

    def chosen(self) -> list[bool]:
        """Nodes of the main text."""

        n = len(self.page.tag)
        parent = self.page.parent
        kept = [False] * n
        best = max(range(n), key=lambda k: (self.sum[k], -k))
        if not self.sum[best]:  # text right in the body
            best = self.body
        path = self._path(best)
        marked = [k for k in path if self.article[k]]
        if marked:
            kept[next((k for k in marked if self.page.tag[k] == "article"), marked[-1])] = True
        else:
            threshold = min(self.density[k] for k in path)
            below = list(range(n))  # the node of the largest sum within each
            for k in range(n - 1, 0, -1):
                if self.sum[below[k]] >= self.sum[below[parent[k]]] and below[k] != below[parent[k]]:
                    below[parent[k]] = below[k]
            kept[best] = True
            for k in range(n):
                if self.chars[k] and self.density[k] >= threshold and k not in path:
                    kept[below[k] if self.sum[below[k]] else k] = True
                elif self.page.tag[k] == "h1":
                    kept[k] = True
        for k in range(1, n):
            kept[k] |= kept[parent[k]]
        return [a and not b for a, b in zip(kept, self.noise, strict=True)]


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in order, joined by one space, white space within them made one space."""

    if not source:
        return ""
    page = Page(source)
    kept = Densities(page).chosen()
    return " ".join("".join([text for node, text in page.text if node < 0 or kept[node]]).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text) of every row.

    Null, empty and blank pages, and pages of nothing but menus and the like, have an empty text.
    A page that ends within a tag, comment or quotation is read up to there, one without a body as if
    all of it were one.  Rows with equal ids or pages are rows of their own; nulls in other columns stay
    null; further columns are not read; no rows give none.  Work and memory follow a page's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(t) for t in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
