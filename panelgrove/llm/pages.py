"""Main text of web pages by tree scoring.

A page is read into a tree that forgives missing and stray end tags. Every block of text (a paragraph, or a
container's own text) earns points for its length and its commas; its container gets them in full and every
further ancestor half of what the one below passed on. A container's score is what it holds so, weighted by
what its tag and names say, times the share of its text outside links. The best container is the article,
joined by the siblings that score well themselves, read like sentences, or are the page's heading.

What can't be an article takes no part: scripts, styles, forms, menus, headers, footers, sidebars, and containers
whose names say notice, advert, comments and the like. Where nothing is left without those, names are
not believed and the page is scored again. Inside the article such parts stay out as well, and so do lists, tables
and containers that are mostly links.

Defined cases: a null or empty page, and one without text outside such parts, has the empty text; character
references are decoded once, also without their semicolon, and unknown ones stay as they are; white space
(any Unicode kind) inside a block becomes one space; blocks are joined by a space, inline tags join nothing and part
nothing, a line break is white space; an unclosed comment, script or tag swallows the rest of the page, as in
browsers; texts are read whole and depth has no limit; rows are judged one by one, so repeated rows give repeated
results; of equal scores the first container in page order wins; empty tables give empty ones; other columns are not read
by the query and stay in :func:`extract`, where ``main_text`` is replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

# The tags of HTML by their role, and words that names of page parts use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|iframe|title|svg|object|canvas|noembed|noframes|xmp"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mrow msub msup nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NEVER = frozenset("nav footer aside form button select option optgroup datalist input menu menuitem dialog fieldset legend audio video map applet".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open one of the set, if no container of the second set lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "body": (frozenset(["head"]), frozenset()),
}
TAG_POINTS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "blockquote": 1.0, "td": 1.0, "ul": -5.0, "ol": -5.0, "dl": -5.0, "table": -3.0, "body": -10.0, "html": -20.0}
GOOD_NAMES = frozenset("article articlebody blog body content entry main post story text".split())
BAD_NAMES = frozenset(
    "ad adbox adbanner adblock adcontainer ads adsbygoogle adslot adspace adunit adwrap adwrapper advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs byline-share captcha comment comments commentlist consent cookie cookies "
    "copyright disqus gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall "
    "popup privacy promo promoted promotion recommended register related reply replies respond rss search share sharing shoutbox sidebar signin signup skip social "
    "sponsor sponsored subscribe subscription taboola tags toolbar topnav tracking warning widget widgets alert disclaimer mainmenu sidenav submenu".split()
)
#: Names that only say so of a part that has no good name.
WEAK_NAMES = frozenset("aside bottom foot footer head header infobar meta side topbar utility".split())
#: The same inside longer words, as in names without a hyphen.
BAD_PARTS = re.compile("comment(?!a)|sidebar|cookie|advert|newsletter|breadcrumb|disqus|sponsor")
#: Words about the layout of a page or part, not about what it holds.
LAYOUT = re.compile(r"(?:has|with|no|without|is|layout|template|one|two|three)[-_].*|.*(?:sidebar|menu|nav|comments?)[-_]?(?:left|right|none|off|open|closed|both|full|visible|hidden)")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Containers whose own names are never held against them.
SPARED = frozenset("html body article main".split())
#: Points from which a sibling counts, as a share of the best score, and the least a sibling needs.
SIBLING, LEAST = 0.2, 5.0

#: The rest of a tag: quotes hold values behind an equals sign only.
_VALUES = r"""(?:[^>=]++|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?)*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({RAW})\b{_VALUES}(?:>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))|\Z)"
    rf"|<(/?)([a-z][a-z0-9:-]*)({_VALUES})(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME_PART = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


def _names(value: str) -> set[str]:
    return {w.lower() for w in _NAME_PART.findall(value)}


class Node:
    __slots__ = ("tag", "up", "block", "parts", "bad", "weight", "points", "score", "chars", "linked", "at")

    def __init__(self, tag: str, up: Node | None, at: int):
        self.tag, self.up, self.at = tag, up, at
        #: The nearest node that is no inline tag, itself included.
        self.block = up.block if up is not None and tag in INLINE else self
        #: Texts and child nodes, in page order.
        self.parts: list = []
        self.bad, self.weight = tag in NEVER, TAG_POINTS.get(tag, 0.0)
        self.points = self.score = 0.0
        self.chars = self.linked = 0

    def read(self, attributes: str, believe: bool) -> None:
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if kind in ("class", "id"):
                found = [w for word in value.split() if not LAYOUT.fullmatch(word.lower()) for w in (_names(word) | {word.lower()})]
                good, bad = any(w in GOOD_NAMES for w in found), any(w in BAD_NAMES or BAD_PARTS.search(w) for w in found)
                bad = bad or (not good and any(w in WEAK_NAMES for w in found))
                if bad and self.tag not in SPARED or bad and self.tag == "article" and any("comment" in w or w == "reply" for w in found):
                    self.bad = self.bad or believe
                    self.weight -= 25
                elif good:
                    self.weight += 10
            elif kind == "role":
                self.bad = self.bad or value.lower() in BAD_ROLES and self.tag not in SPARED
                self.weight += 15 * (value.lower() in ("main", "article"))
            elif kind == "itemprop":
                self.weight += 25 * (value.lower() == "articlebody")
                self.bad = self.bad or value.lower() == "comment"
            elif kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                self.bad = True
            elif kind == "style":
                self.bad = self.bad or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None


def parse(page: str, believe: bool = True) -> tuple[list[Node], str]:
    """All nodes in page order, the root first, and the page's title."""
    root = Node("html", None, 0)
    nodes, here, title, end = [root], root, "", 0

    opened: Counter[str] = Counter()

    def shut_at(n: Node) -> None:
        """Close ``n`` and all that is open in it."""
        nonlocal here
        while here is not n.up:
            opened[here.tag] -= 1
            here = here.up

    def close(tags: frozenset, walls: frozenset) -> None:
        n = here if any(opened[t] for t in tags) else root
        while n is not root and n.tag not in walls:
            if n.tag in tags:
                return shut_at(n)
            n = n.up

    for m in _TOKEN.finditer(page):
        if m.start() > end:
            here.parts.append(page[end : m.start()])
        end = m.end()
        raw, shut, tag = m.group(1), m.group(2), (m.group(3) or "").lower()
        if raw is not None:
            if raw.lower() == "title" and not title:
                title = html.unescape(re.sub(r"<[^>]*>", "", m.group()))
            continue
        if m.group().startswith("<![CDATA["):
            here.parts.append(html.escape(m.group()[9:].removesuffix("]]>")))
        if not tag or tag == "html":
            continue
        if shut:
            # An inline end tag does not reach beyond the block it stands in; stray ones do nothing.
            n = here if opened[tag] else root
            while n is not root and n.tag != tag and not (tag in INLINE and n.tag not in INLINE):
                n = n.up
            if n is not root and n.tag == tag:
                shut_at(n)
            continue
        if tag not in INLINE and tag not in VOID:
            # A block ends an open paragraph or heading, and with it the inline tags left open in it.
            n = here.block
            if n.tag == "p" or n.tag in HEADINGS and tag in HEADINGS:
                shut_at(n)
            if tag in ENDS:
                close(*ENDS[tag])
        node = Node(tag, here, len(nodes))
        if m.group(4):
            node.read(m.group(4), believe)
        nodes.append(node)
        here.parts.append(node)
        if tag not in VOID and not m.group().endswith("/>"):
            here = node
            opened[tag] += 1
    if end < len(page):
        here.parts.append(page[end:])
    return nodes, " ".join(title.split())


def _blocks(node: Node) -> list[tuple[Node, str, int]]:
    """(container, text, characters in links) of the blocks below ``node``, bad parts left out."""
    out: list[tuple[Node, str, int]] = []
    held: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((owner, text, min(linked, len(text))))
        linked = 0

    stack: list[tuple[Node, Node, int, bool]] = [(node, node, 0, False)]
    while stack:
        n, owner, at, link = stack.pop()
        while at < len(n.parts):
            p = n.parts[at]
            at += 1
            if isinstance(p, str):
                held.append(p)
                if link:
                    linked += len(p.strip())
            elif p.bad:
                held.append(" ")
            elif p.tag in VOID:
                if p.tag == "hr":
                    flush(owner)
                elif p.tag == "br":
                    held.append(" ")
            else:
                stack.append((n, owner, at, link))
                if p.tag in INLINE:
                    stack.append((p, owner, 0, link or p.tag == "a"))
                else:
                    flush(owner)
                    stack.append((p, p, 0, link))
                break
        else:
            if n.tag not in INLINE or n is node:
                flush(owner)
    return out


def _measure(nodes: list[Node]) -> None:
    """Points, text and link lengths of all nodes, from the blocks up."""
    for owner, text, linked in _blocks(nodes[0]):
        owner.chars += len(text)
        owner.linked += linked
        if owner.tag in HEADINGS:
            continue
        points = (1 + text.count(",") + text.count("，") + text.count("、") + len(text) / 100) * (1 - linked / len(text))
        # A paragraph's points are its container's; a container's own text is its own.
        target = owner.up if owner.up is not None and owner.tag in ("p", "pre", "li", "dd", "dt") else owner
        if owner.tag == "li" and target.up is not None:
            points *= 0.5
        target.points += points
    passed = [0.0] * len(nodes)
    for n in reversed(nodes):
        passed[n.at] += n.points
        n.score = (passed[n.at] + (n.weight if passed[n.at] else 0)) * (1 - n.linked / n.chars if n.chars else 0)
        if n.up is not None:
            passed[n.up.at] += passed[n.at] / 2
            n.up.chars += n.chars
            n.up.linked += n.linked


def _links_only(n: Node) -> bool:
    return n.tag in ("ul", "ol", "dl", "table", "div", "section") and n.chars > 0 and n.linked > 0.5 * n.chars


def _text(n: Node) -> list[str]:
    """Blocks of the article below ``n``."""
    skip = [x for x in _below(n) if x is not n and _links_only(x)]
    for x in skip:
        x.bad = True
    return [t for _, t, _ in _blocks(n)]


def _below(n: Node):
    todo = [n]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(p for p in x.parts if not isinstance(p, str))


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    for believe in (True, False):
        nodes, title = parse(page, believe)
        _measure(nodes)
        seen = [n for n in nodes if n.chars and n.tag not in INLINE and n.tag not in HEADINGS and n.tag != "p"]
        if not seen:
            continue
        best = max(seen, key=lambda n: (n.score, -n.at))
        out: list[str] = []
        for p in best.up.parts if best.up is not None else [best]:
            if isinstance(p, str) or p.bad:
                continue
            if p is best or _joins(p, best, title):
                out.extend(_text(p))
        if out:
            return " ".join(out)
    return ""


def _joins(p: Node, best: Node, title: str) -> bool:
    """Whether a sibling belongs to the article."""
    if not p.chars or _links_only(p):
        return False
    share = p.linked / p.chars
    if p.tag in HEADINGS or p.tag == "header":
        own = " ".join(_text(p))
        return share < 0.5 and bool(title) and (own.startswith(title) or title.startswith(own))
    if p.tag == "p":
        own = " ".join(_text(p))
        return share < 0.25 and (len(own) > 80 or share == 0 and re.search(r"[.!?。](\s|$)", own) is not None)
    return p.score >= max(LEAST, SIBLING * best.score) and share < 0.3


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with the article of each as ``main_text``."""

    def make():
        return lambda b: [[main_text(x) for x in b.column(html_column).to_pylist()]]

    return map_arrow(pages, make, [("main_text", T.StringType())], pages.columns)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


#: What the given pages hold: one article each, marked by its tag, with references of three kinds.
ORACLE_OP13 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
