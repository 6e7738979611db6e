"""Main text of web pages by tree scoring.

Each page becomes a small tree.  Elements that are never article text (navigation, header, footer, asides, forms,
scripts, hidden parts) are dropped; of a header inside an article the headings stay.  A class, id or role marks an element as an advert,
menu, notice or the like only when each word of one of its names says so or is a mere word of layout ("ad-box", not "no-ads" or "social-science").
Marked elements are dropped whatever their size, but for those around an article or main element; where nothing else on the page holds any text
they stay, comments excepted.
Paragraphs pass points, one plus their commas plus their length up to three hundred characters, to their ancestors: all to the
parent, half to the grandparent, less to the next two.  A container's score is discounted by the share of its text inside links.
The best container is kept, widened to the article or main element around it, with those of its siblings that score
a fifth of it, are articles themselves or are long paragraphs with few links.

Without any scored container the page's articles, main or body are kept.  Text keeps page order; inline elements do not
break words, block elements and line breaks do.  A null or empty page has the empty text, an empty table gives an empty result, very long
pages are parsed whole, and extra columns are not read.  Rows are independent: repeated rows and null ids are pages like others.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import rows

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
                  r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
#: Elements that are never article text.
DROP = frozenset("head nav header footer aside form button select option datalist fieldset menu dialog script style noscript template "
                 "iframe object embed applet svg math canvas audio video map textarea title input".split())
#: Words in a class, id or role that mark what is not article text.
DROP_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle banner banners promo promoted promotion sponsor sponsored sponsors "
                       "nav navbar navigation menu menus sidebar sidebars aside header masthead footer contentinfo complementary breadcrumb "
                       "breadcrumbs pagination pager cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter "
                       "subscribe subscription signup login share sharing social related recommended widget toolbar search skip".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words of layout, which say nothing alone.
LAYOUT_WORDS = frozenset("area bar block body bottom box btn button buttons col column container desktop fixed global group holder icon icons inner item items "
                         "left link links list message messages mobile module outer page panel posts primary region right row secondary section site slot "
                         "sticky stories text thread title top unit wrap wrapper x zone".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Why an element is dropped: never, always, by its names, by names of comments.
KEEP, ALWAYS, MARKED, COMMENT = range(4)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "points", "chars", "linked", "commas")

    def __init__(self, tag: str, parent: Node | None, drop: int = KEEP):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], drop
        self.points = 0.0
        self.chars = self.linked = self.commas = 0


def _named(value: str) -> int:
    """What the names of a class, id or role say."""
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        telling = {w for w in words if not w.isdigit()} - LAYOUT_WORDS
        if telling and telling <= DROP_WORDS | COMMENT_WORDS:
            return COMMENT if telling & COMMENT_WORDS else MARKED
    return KEEP


def _dropped(tag: str, attrs: str) -> int:
    if tag in DROP:
        return ALWAYS
    if not attrs or tag in ("html", "body"):
        return KEEP
    why = KEEP
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            why = max(why, _named(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return ALWAYS
    if tag in HEADINGS or (tag in ("article", "main") and why == MARKED):
        return KEEP
    return why


def _settle(root: Node) -> None:
    """Decide on the marked elements, and keep the headings of headers inside articles."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        if node.tag == "header" and inside:
            node.drop = KEEP
            node.children = [x for x in node.children if not isinstance(x, str) and (x.tag in HEADINGS or x.tag == "hgroup")]
        if node.drop == ALWAYS:
            continue
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        stack.extend((c, inside) for c in node.children if not isinstance(c, str))
    holds = {id(x): False for x in order}
    for node in reversed(order):
        if node.parent is not None:
            holds[id(node.parent)] |= holds[id(node)] or (node.tag in ("article", "main") and node.drop == KEEP)
    for node in order:
        if holds[id(node)]:
            node.drop = KEEP
    if not _has_text(root):  # names say little where all text is in marked elements
        for node in order:
            if node.drop == MARKED:
                node.drop = KEEP


def _has_text(root: Node) -> bool:
    stack = [root]
    while stack:
        for c in stack.pop().children:
            if isinstance(c, str):
                if c.strip():
                    return True
            elif not c.drop:
                stack.append(c)
    return False


def parse(page: str) -> Node:
    root = at = Node("html", None)
    pos, n = 0, len(page)
    while pos < n:
        lt = page.find("<", pos)
        m = _TAG.match(page, lt) if lt >= 0 else None
        if lt < 0:
            at.children.append(html.unescape(page[pos:]))
            break
        if lt > pos:
            at.children.append(html.unescape(page[pos:lt]))
        if m is None:  # a bare "<" is text
            at.children.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            node = at
            while node is not root and node.tag != tag:
                if tag in INLINE and node.tag not in INLINE:
                    node = root
                    break
                node = node.parent
            if node is not root:
                at = node.parent
            continue
        attrs = m[3] or m[6] or ""
        if tag not in INLINE:
            # a block start ends an open paragraph; list items, rows and cells end their like
            close = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                     "option": ("option",)}.get(tag, ())
            node = at
            while node is not root and (node.tag in INLINE or node.tag == "p" or node.tag in close):
                if node.tag == "p" or node.tag in close:
                    at = node.parent
                node = node.parent
            if tag == "body":
                at = root
        node = Node(tag, at, _dropped(tag, attrs))
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, pos)
            node.drop = ALWAYS
            pos = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            at = node
    return root


def _measure(root: Node) -> list[Node]:
    """Characters, link characters and commas of each kept element, without recursion; elements in page order."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        inside = inside or node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                k = len(c.strip())
                node.chars += k
                node.linked += k * inside
                node.commas += c.count(",") + c.count("、") + c.count("，")
        for c in reversed(node.children):
            if not isinstance(c, str) and not c.drop:
                stack.append((c, inside))
    own = {id(x): x.chars for x in order}
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.commas += node.commas
    for node in order:
        if node.tag in ("p", "pre", "td", "blockquote") or (node.tag not in INLINE and own[id(node)] >= 80):
            if node.chars >= 25:
                points, up = 1 + node.commas + min(node.chars // 100, 3), node.parent
                for share in (1, 2, 6, 9):
                    if up is None:
                        break
                    up.points += points / share
                    up = up.parent
    return order


def _density(x: Node) -> float:
    return x.linked / x.chars if x.chars else 0.0


def _text(nodes: list[Node]) -> str:
    out: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            if x.tag in INLINE:
                stack.extend(reversed(x.children))
            else:
                out.append(" ")
                stack.append(" ")
                stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    order = _measure(root)
    scored = [x for x in order if x.points > 0 and x.tag not in INLINE and x.tag != "html"]
    if not scored:
        for tag in ("article", "main", "body"):
            found = [x for x in order if x.tag == tag]
            if found:
                return _text(found if tag == "article" else found[:1])
        return _text([root])
    score = {id(x): x.points * (1 - _density(x)) for x in scored}
    best = max(scored, key=lambda x: score[id(x)])
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("body", "main"):
        return _text([best])
    least = 0.2 * best.points * (1 - _density(best))
    kept = [x for x in best.parent.children if not isinstance(x, str) and (
        x is best or (not x.drop and ((x.tag == "article" and x.chars > 0) or score.get(id(x), 0) >= least or (x.tag == "p" and x.chars > 80 and _density(x) < 0.25))))]
    return _text(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows(batches, 256):
        text = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (page_id, url, text, n_chars), one row per page."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
