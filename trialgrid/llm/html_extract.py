"""Main text of web pages by tree scoring.

A page is read into a tree of elements. Paragraphs earn points for their length
and commas and pass them to their ancestors, half at each further step; the share
of a container's text that stands in links takes points away. From the container
with most points the article reaches up to its article, main or body element, with
all siblings on the way that are not made of links.

Names and tags of page parts (menus, notices, comments ...) make an element
suspect. A suspect is left out, unless it holds what the page is about: most of
its points, or all that would otherwise be lost. Inside an article or main
element only menus, forms, footers and parts whose whole name is that of a part
(``ad``, ``comments``, ``related-posts``) are suspect, and others if half of them is links.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag as HTML reads it: quotes count only right after an equals sign.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(/?)([A-Za-z][^\s/>]*)((?>[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)?)?|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

_ALONE = re.compile(r"(?:^|[\s\"'])/$")

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "xmp", "object", "canvas"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "param", "source", "track", "wbr"}
#: Never text, whatever they hold.
_DROP = {"head", "button", "select", "input", "audio", "video"} | _RAW
#: Sources of formulas, which stand beside what is shown.
_SOURCES = {"annotation", "annotation-xml"}
#: Dropped inside a line, which goes on behind them.
_INLINE = {"svg", "canvas"}
#: Suspect by tag.
_PARTS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "label", "fieldset"}
_BLOCK = {"p", "div", "article", "section", "main", "body", "html", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "pre", "blockquote", "table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "figure", "figcaption", "address", "hr", "center", "details", "summary"} | _PARTS | (_DROP - _INLINE)
_CLOSES_P = _BLOCK - {"label", "button", "input", "select"}
#: Elements that an opening one of the same kind ends, and what stops the search.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_PARAGRAPH = {"p", "pre", "td", "blockquote", "li", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
_HOLDER = {"div", "section", "article", "main", "body"}
#: What readers write; such parts can be longer than the article.
_READERS = {"comment", "comments", "commentlist", "respond", "disqus", "reply", "replies"}
#: Names of page parts that are not the article; words of class, id and role.
_NAMES = _READERS | {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promos", "promotion", "banner",
    "sidebar", "side", "widget", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "footer", "foot", "header", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "share", "sharing", "social", "related", "recommended", "recommendations", "tags", "skip", "copyright", "legal", "disclaimer", "complementary", "contentinfo", "search", "hidden",
}
#: Inside an article, tags that are no part of it; others, and names, speak against what is made of links.
_NOT_ARTICLE = {"nav", "footer", "form", "dialog", "label", "fieldset"}
#: Names that speak against a part of an article too, if nothing else is in the name but what is said of any part.
_NOT_IN_ARTICLE = _NAMES - {"side", "footer", "foot", "header", "menu", "notice", "alert", "tags", "search", "legal", "copyright", "disclaimer", "promotion", "complementary", "contentinfo", "notification"}
_ANY_PART = {"area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "icons", "inline", "inner", "item", "items", "links", "list", "post", "posts", "section", "slot", "stories", "thread", "top", "unit", "wrap", "wrapper"}
#: A name with one of these tells of something the element has, or has not.
_ABOUT = {"has", "have", "with", "without", "no", "not", "non", "free", "off", "is"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Degrees of suspicion; linked parts are left out if they are made of links.
CLEAN, LINKED, NAMED, PART, READERS = range(5)


class Node:
    __slots__ = ("tag", "parent", "kids", "junk", "doubt", "score", "flow", "points", "words", "linked", "heads")

    def __init__(self, tag: str, parent: Node | None, doubt: int = CLEAN, junk: bool = False):
        self.tag, self.parent, self.doubt, self.junk = tag, parent, doubt, junk
        self.kids: list[Node | str] = []
        self.score = self.flow = self.points = 0.0
        self.words = self.linked = 0
        self.heads = False


def _doubt(tag: str, attributes: str, in_article: bool) -> int:
    """How much tag and names speak against an element.

    Inside an article they say less: its head, asides and lists belong to it, a
    paragraph is never judged by its name, and a name counts only if all of it
    speaks against the part. What they would count outside makes a part suspect
    of being links.
    """
    doubt = PART if tag in (_NOT_ARTICLE if in_article else _PARTS) else LINKED if tag in _PARTS and tag != "header" else CLEAN
    if attributes and tag not in ("html", "body", "main"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _HIDDEN.search(value)):
                doubt = max(doubt, PART)
            elif name in ("class", "id", "role"):
                for word in value.split():
                    parts = set(re.split(r"[_-]+", word))
                    if parts & _NAMES and not parts & _ABOUT:
                        spoken = READERS if parts & _READERS else NAMED
                        whole = tag not in _PARAGRAPH and parts & _NOT_IN_ARTICLE and parts <= _NOT_IN_ARTICLE | _ANY_PART
                        doubt = max(doubt, LINKED if in_article and not whole else spoken)
    return CLEAN if doubt == NAMED and tag == "article" else doubt


class _Open:
    """The elements that are open, found by tag without walking over the others."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {"html": [0]}
        self.blocks, self.walls = [0], [0]

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in _BLOCK:
            self.blocks.append(k)
        if node.tag in ("table", "body"):
            self.walls.append(k)

    def cut(self, k: int) -> None:
        """Close number ``k`` and all opened since; the root stays."""
        while len(self.nodes) > max(k, 1):
            self.at[self.nodes.pop().tag].pop()
        for held in (self.blocks, self.walls):
            while len(held) > 1 and held[-1] >= len(self.nodes):
                held.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, tag: str) -> None:
        k = self.last((tag,))
        if k > 0 and (k >= self.walls[-1] or tag in ("html", "body", "table")):
            self.cut(k)

    def make_room(self, tag: str) -> None:
        """Put in the end tags that an opening ``tag`` implies."""
        if tag in _CLOSES_P and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            stop = self.last(stops)
            later = [held[bisect_right(held, stop)] for t in ends if (held := self.at.get(t)) and held[-1] > stop]
            if later:
                self.cut(min(later))


def parse(source: str) -> Node:
    """A page as a tree, with the end tags that authors leave out put in, in time linear in its length."""
    root = Node("html", None)
    open_, at, n, seen = _Open(root), 0, len(source), set()
    while at < n:
        found = _TOKEN.search(source, at)
        here = open_.nodes[-1]
        if not found:
            here.kids.append(source[at:])
            break
        if found.start() > at:
            here.kids.append(source[at : found.start()])
        at = found.end()
        if not found.group(2):
            continue
        tag, attributes = found.group(2).lower(), found.group(3)
        if found.group(1):
            open_.close(tag)
            continue
        alone = tag in _VOID or _ALONE.search(attributes) is not None
        if tag in _RAW and not alone:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            if tag in _BLOCK:
                here.kids.append(Node(tag, here, junk=True))
            continue
        open_.make_room(tag)
        if tag in ("html", "body"):
            if tag in seen:
                continue
            seen.add(tag)
        here = open_.nodes[-1]
        node = Node(tag, here, _doubt(tag, attributes, open_.last(("article", "main")) > 0), tag in _DROP or tag in _SOURCES)
        here.kids.append(node)
        if not alone:
            open_.push(node)
    return root


_SPACE = re.compile(r"\s+")
_NOSCRIPT = re.compile(r"</?noscript\b[^>]*>", re.I)


def _blocks(top: Node) -> Iterator[str]:
    """The texts between block borders, in page order, white space folded, without junk."""
    held: list[str] = []

    def flush() -> Iterator[str]:
        text = _SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            yield text

    stack = [(top, iter(top.kids))]
    while stack:
        current, kids = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                held.append(html.unescape(kid))
            elif kid.tag == "br":
                held.append("\n")
            else:
                if kid.tag in _BLOCK:
                    yield from flush()
                if not kid.junk:
                    stack.append((kid, iter(kid.kids)))
                    break
        else:
            stack.pop()
            if current.tag in _BLOCK:
                yield from flush()
    yield from flush()


def _order(root: Node) -> list[Node]:
    """All elements that are not junk, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in node.kids if isinstance(k, Node) and not k.junk)
    order.reverse()
    return order


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of every element, and the points that paragraphs pass up. Children come before parents."""
    order = _order(root)
    for node in order:
        own = commas = received = 0
        node.words = node.linked = 0
        node.points, node.heads = 0.0, node.tag in ("h1", "main", "article")
        for kid in node.kids:
            if isinstance(kid, str):
                own += len(kid.strip())
                commas += kid.count(",") + kid.count("、") + kid.count("،")
            elif not kid.junk:
                node.words += kid.words
                node.linked += kid.linked
                node.points += kid.points
                node.heads |= kid.heads
                received += kid.flow
        node.words += own
        if node.tag == "a":
            node.linked = node.words
        direct = own if node.tag not in _PARAGRAPH else node.words
        points = 0.0
        if (node.tag in _PARAGRAPH or node.tag in _HOLDER) and direct >= 25:
            points = (1 + commas + min(direct / 100, 3)) * (1 - node.linked / max(1, node.words))
        node.points += points
        node.score = received + (0 if node.tag in _PARAGRAPH else points)
        node.flow = points + received / 2
    return order


def _judge(root: Node) -> None:
    """Make junk of suspects, from the outside in, unless they hold what the page is about."""
    for node in _order(root):
        if node.doubt == LINKED and node.words and _density(node) >= 0.5:
            node.doubt = PART
    total = root.points
    readers, stack, told = 0.0, [root], False
    while stack:
        node = stack.pop()
        told |= node.tag in ("article", "main") and node.words > 0
        if node.doubt == READERS:
            readers += node.points
        else:
            stack.extend(k for k in node.kids if isinstance(k, Node) and not k.junk)
    subject = total - readers if readers < total else total

    def dropped(bar: int) -> tuple[list[Node], float, bool]:
        out, left, named, stack = [], total, False, [root]
        while stack:
            node = stack.pop()
            most = subject > 0 and node.points >= subject / 2 and (node.heads or (node.doubt < READERS and not told))
            if node.doubt >= bar and not most:
                out.append(node)
                left -= node.points
            else:
                named |= node.tag in ("article", "main") and node.words > 0
                stack.extend(k for k in node.kids if isinstance(k, Node) and not k.junk)
        return out, left, named

    for bar in (NAMED, PART, READERS):
        out, left, named = dropped(bar)
        if named or left >= subject / 4:
            break
    for node in out:
        node.junk = True


def _density(node: Node) -> float:
    return node.linked / node.words if node.words else 0.0


def main_text(source: str | None) -> str:
    """The article of a page: blocks joined by an empty line; empty if there is none."""
    if not source:
        return ""
    found = _article(source)
    # a page for readers without scripts may have all its text in such elements
    return found or (_article(_NOSCRIPT.sub("", source)) if _NOSCRIPT.search(source) else "")


def _article(source: str) -> str:
    root = parse(source)
    _measure(root)
    _judge(root)
    order = _measure(root)
    holders = [n for n in order if n.tag not in _PARAGRAPH and n.tag in _BLOCK]
    best = max(holders, key=lambda n: n.score * (1 - _density(n)), default=root)
    if best.score <= 0:  # no paragraph of any length: what an article element holds, or the page without its other parts
        named = [n for n in reversed(order) if n.tag in ("article", "main")]
        best = (named or [root])[0]
    top, tops = best, []
    while top is not None:
        if top.tag in ("article", "main"):
            tops.append(top)
        top = top.parent
    stop = tops[-1] if tops else root
    while best is not stop:
        for kid in best.parent.kids:
            if kid is not best and isinstance(kid, Node) and _density(kid) >= 0.5:
                kid.junk = True
        best = best.parent
    return "\n\n".join(_blocks(stop))


def _extracting(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars), one row per input row.

    White space inside a block is folded to one space, blocks are joined by two
    line feeds, character references are decoded. Headings and lists inside the
    article are kept, nothing is capped.

    Null or empty markup, and pages without text, give an empty text; plain text
    without tags is one block; unclosed elements end where their parent does; of
    containers with equal scores the innermost first one wins; rows that repeat
    an id are pages of their own; other columns play no part.
    """
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(markup).alias("html")).mapInArrow(
        _extracting, "page_id long, url string, text string, n_chars long"
    )
