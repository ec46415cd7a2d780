"""Main text of web pages by composite text density.

A page becomes a tree of elements. Each node has its characters, those inside links, its tags and its link tags;
its density is characters per tag, lowered by the share of links. The node whose children have the largest sum of
densities is the core of the text; the least density on the path from it to the body is the threshold that other
parts must reach to be text as well. Elements that say what they are (menus, footers, adverts, forms, comments, ...)
are left out before anything is counted.

A page is one row's work in an Arrow batch; nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

# Elements of HTML by what they do to text, and words by which pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("head nav footer aside form button select option textarea input script style noscript template iframe object embed canvas svg audio video dialog menu datalist title".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
PART_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner leaderboard skyscraper sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc header masthead skip topbar toolbar footer foot bottombar copyright "
    "bottom sidebar side rail secondary aside widget widgets related recommended recommendations trending popular share sharing social follow "
    "cookie cookies consent disclaimer gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login paywall "
    "comment comments commentlist reply replies respond responses disqus discussion form search".split()
)
#: Ends of names that are written as one word, such as topnav or sitefooter.
PART_ENDS = ("nav", "menu", "footer", "sidebar", "banner", "advert", "comments")
#: Elements that end an open paragraph; which open elements a start tag ends, up to what.
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul dd dt td th tr tbody thead tfoot".split())
ENDS_LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("article", "main"))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-hidden|hidden|style)(?![\w-])\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LAYOUT = ("has-", "with-", "without-", "no-", "has_", "with_", "no_")


def _names(value: str) -> Iterator[str]:
    """The words in class names; a name such as with-sidebar says nothing about its own element."""
    for name in value.split():
        if not name.lower().startswith(_LAYOUT):
            yield from (w.lower() for w in _NAME.findall(name))


def _unwanted(tag: str, attrs: str) -> int:
    """2: an element that is never text; 1: named like a part that is none, which holds unless it contains the article."""
    if tag in LEFT_OUT:
        return 2
    out = int(tag == "header")
    if attrs and tag not in ("html", "body", "main"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return 2
            if name == "role" and value.lower() in LEFT_OUT_ROLES:
                out = 1
            if name in ("class", "id") and any(w in PART_NAMES or w.endswith(PART_ENDS) for w in _names(value)):
                out = 1
    return out


class Tree:
    """Elements in page order (a parent before its children) and the texts between the tags."""

    def __init__(self, page: str):
        self.tag, self.parent, self.unwanted = ["html"], [-1], [0]
        self.texts: list[tuple[int, str]] = []  # node and decoded text; "\n" where a block or line begins or ends
        self.stack, self.open = [0], {"html": 1}
        self._read(page)

    def _read(self, page: str) -> None:
        at, pattern, end = 0, _TAG, len(page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                return
            if lt > at:
                self._text(page[at:lt])
            following = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                close = page.find("-->", lt + 4)
                at = end if close < 0 else close + 3
            elif following in ("!", "?"):
                close = page.find(">", lt)
                at = end if close < 0 else close + 1
            elif following.isascii() and following.isalpha() or following == "/":
                m = pattern.match(page, lt)
                if not m and pattern is _TAG:  # a quote that never ends: from here on tags end at the next >
                    pattern = _PLAIN_TAG if page.find(">", lt) >= 0 else _TAG
                    m = pattern.match(page, lt)
                close = page.find(">", lt)
                if close < 0:
                    return  # the page ends inside a tag
                at = m.end() if m else close + 1
                if m and m[1]:
                    self._end(m[2].lower())
                elif m:
                    tag = m[2].lower()
                    self._start(tag, m[3])
                    if tag in RAW:
                        stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                        at = stop.start() if stop else end
            else:
                self._text("<")
                at = lt + 1

    def _text(self, raw: str) -> None:
        self.texts.append((self.stack[-1], html.unescape(raw) if "&" in raw else raw))

    def _break(self, tag: str) -> None:
        if tag not in INLINE:
            self.texts.append((self.stack[-1], "\n"))

    def _pop(self) -> None:
        tag = self.tag[self.stack[-1]]
        self._break(tag)
        self.open[tag] -= 1
        self.stack.pop()
        self._break(tag)

    def _start(self, tag: str, attrs: str) -> None:
        if tag == "html":
            return
        if tag in ENDS_P and self.open.get("p"):
            top = len(self.stack) - 1
            while top > 0 and self.tag[self.stack[top]] in INLINE:
                top -= 1
            if self.tag[self.stack[top]] == "p":
                while len(self.stack) > top:
                    self._pop()
        if tag in ENDS_LIKE:
            like, scope = ENDS_LIKE[tag]
            while any(self.open.get(x) for x in like) and self.tag[self.stack[-1]] not in scope and (self.tag[self.stack[-1]] in like or self.tag[self.stack[-1]] in INLINE or self.tag[self.stack[-1]] == "p"):
                self._pop()
        self._break(tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.unwanted.append(_unwanted(tag, attrs))
        if tag not in VOID and not attrs.endswith("/"):
            self.stack.append(len(self.tag) - 1)
            self.open[tag] = self.open.get(tag, 0) + 1
            self._break(tag)

    def _end(self, tag: str) -> None:
        if tag == "p" and not self.open.get("p"):
            self._break("p")
        if not self.open.get(tag) or tag == "html":
            return
        if tag in INLINE:
            top = len(self.stack) - 1
            while self.tag[self.stack[top]] in INLINE and self.tag[self.stack[top]] != tag:
                top -= 1
            if self.tag[self.stack[top]] != tag:
                return  # a block has been opened inside; the element ends with it
        while self.tag[self.stack[-1]] != tag:
            self._pop()
        self._pop()


def density(chars: int, links: int, tags: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Characters per tag times a logarithm that falls as more of them are inside links; its base grows with the links
    of the node and of the body, so that a page full of links is stricter."""
    if not chars:
        return 0.0
    c, lc, t, lt = chars, max(links, 1), max(tags, 1), max(link_tags, 1)
    base = math.log(c / max(chars - links, 1) * links + body_links / max(body_chars, 1) * c + math.e)
    return c / t * math.log(c / lc * t / lt + 1) / math.log(max(base, 1.1))


def left_out(tree: Tree, by_name: bool) -> list[bool]:
    """Which nodes are no candidates for main text: by what they are and, unless an article is inside, by their names."""
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    holds, inside, gone = [False] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i] or (tag[i] in WHOLE and not tree.unwanted[i])
    for i in range(1, n):
        p = parent[i]
        inside[i] = inside[p] or (tag[p] in WHOLE and not tree.unwanted[p])
        named = by_name and tree.unwanted[i] == 1 and not holds[i] and not (tag[i] == "header" and inside[i])
        gone[i] = gone[p] or tree.unwanted[i] == 2 or named
    return gone


def chosen(tree: Tree, by_name: bool = True) -> list[bool]:
    """Which nodes' own texts are main text."""
    n, parent, tag, gone = len(tree.tag), tree.parent, tree.tag, left_out(tree, by_name)
    chars, links, tags, link_tags = ([0] * n for _ in range(4))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tag[i] == "a"
    for i, text in tree.texts:
        if not gone[i]:
            size = len("".join(text.split()))
            chars[i] += size
            links[i] += size * in_link[i]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if not gone[i]:
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    if by_name and not chars[0]:
        return chosen(tree, False)
    body = next((i for i in range(n) if tag[i] == "body" and chars[i] == chars[0]), 0)
    live = [False] * n  # in the body and not left out
    live[body] = True
    for i in range(body + 1, n):
        live[i] = live[parent[i]] and not gone[i]

    dens = [density(chars[i], links[i], tags[i], link_tags[i], chars[body], links[body]) if live[i] else 0.0 for i in range(n)]
    total, top = [0.0] * n, list(range(n))  # sum of the children's densities; of a subtree the node with the largest such sum
    for i in range(n - 1, body, -1):
        total[parent[i]] += dens[i]
    for i in range(n - 1, body, -1):
        if live[i] and total[top[i]] > total[top[parent[i]]]:
            top[parent[i]] = top[i]
    core = at = top[body]
    limit = dens[core]
    while at != body:
        at = parent[at]
        limit = min(limit, dens[at])
    parts = sum(1 for i in range(core + 1, n) if parent[i] == core and chars[i])
    least = chars[core] / max(parts, 1) / 2  # a line beside the text is shorter than half of its parts
    reached, marked, whole = [False] * n, [False] * n, [0] * n
    for i in range(body, n):
        like = i != body and parent[i] == parent[core] and tag[i] == tag[core]  # another section of the same kind
        reached[i] = i == body or (live[i] and reached[parent[i]] and dens[i] * (2 if like else 1) >= limit)
        if reached[i] and (top[i] == core or chars[top[i]] - links[top[i]] >= least):
            marked[top[i]] = True
    for i in range(body + 1, n):
        whole[i] = i if tag[i] in WHOLE else whole[parent[i]]
        if marked[i] and whole[i]:  # an article that has main text is main text
            marked[whole[i]] = True
    last = {parent[i]: i for i in range(body + 1, n) if marked[i]}
    begun: set[int] = set()
    for i in range(body + 1, n):  # what stands between marked neighbours, and headings before them
        p = parent[i]
        if marked[i]:
            begun.add(p)
        elif i < last.get(p, 0) and (p in begun or tag[i] in HEADINGS):
            marked[i] = True
    out = [False] * n
    for i in range(body, n):
        menu = links[i] * 10 > chars[i] * 6 and link_tags[i] > 1 and tag[i] not in INLINE and tag[i] != "p"
        out[i] = live[i] and not menu and (marked[i] or (i > body and out[parent[i]]))
    return out


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by a space; null and empty pages have none."""
    if not page:
        return ""
    tree = Tree(page)
    keep = chosen(tree)
    return " ".join("".join(text if text == "\n" or keep[i] else "" for i, text in tree.texts).split())


def extracted(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Per row: page_id, url, text (main text of the whole page, empty if there is none) and n_chars (its code points).

    Null and empty pages have an empty text, null ids and urls are kept, repeated rows have a row each, an empty
    table gives no rows. Pages of any length and broken markup (unclosed or crossed tags, a page that
    ends inside a tag) are read whole, in a time that grows with their length. Columns that aren't named are not
    read, whatever their names.
    """
    rows = shared.columns(pages, page_id=page_id, url=url, t=markup)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column("t")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(work, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
