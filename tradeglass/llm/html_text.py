"""Main text of web pages by composite text density.

A page is parsed into a tree that forgives missing and misplaced tags. Parts that are never article text
leave it first: scripts, styles, forms, menus, sidebars, page headers and footers, and elements whose role or
style says so. For every other element the composite density is characters per tag, lowered by links:

    C / T * log(C * T / (LC * LT)) to the base ln(C / (C - LC) * LC + LCb / Cb * C + e)

C, T: characters and tags below it; LC, LT: those in links; Cb, LCb: of the body. (Counts of zero take the
place of one where they divide.) The density sum of an element adds up its children's densities. The
element with the largest sum is the article; it grows to an enclosing article or main element. The
least density on the path from the body to it is the threshold: elements beside the path that reach it,
and hold more plain text than link text, are taken in too. A run of loose text and inline elements beside the
path is an element there. All blocks of what is taken are kept, short ones too.

Names (class and id) never decide alone. A class or id is a full name if all its words name adverts, notices,
menus, share bars, reader comments and the like, and a part name if one does. Paragraphs, headings, pre and what
stands in them, and main go by no name, nor does an outermost article unless another bears none. An element with
a name goes if more than half of its text is link text. One with a full name goes also if the densest subtree
is elsewhere: outside the article unless its density sum is larger (reader comments may be longer than the
article, so for them: unless nothing else has text), inside it if it is a block whose density sum stays below
the article's density (reader comments always; the id of a section only with a form or comments in it). Nothing
that holds the article goes.

Odd inputs: null, empty or text-less html gives the empty text; text outside any element counts as a block of
the body; repeated pages and extra columns change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("script style noscript template head title nav aside form button select option textarea input label iframe object embed applet "
                  "canvas svg math audio video map dialog menu".split())
OUTER = frozenset(("header", "footer"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id values that name what is not article text.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
 notices notification alert popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu breadcrumb breadcrumbs
 sidebar sidebars aside widget widgets related recommended recommendations teaser teasers share sharing social comment comments commentlist disqus respond replies reply
 footer masthead topbar toolbar pagination pager skip search tags tagcloud copyright disclaimer hidden""".split())
#: Reader comments, which may be longer than the article, and words that say nothing in a class or id.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
NEUTRAL = frozenset("box bar block wrap wrapper container list area section inner outer links link buttons button item items top bottom left right main site page slot unit".split())
#: No name rules these out, nor what stands in them.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre code".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: An implied end does not reach past these.
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "off", "chars", "tags", "link_chars", "link_tags", "density", "total", "name", "in_text")

    def __init__(self, tag: str, parent: Node | None, off: bool = False, name: str = ""):
        self.tag, self.parent, self.off, self.name = tag, parent, off, name
        self.in_text = tag in TEXT or parent is not None and parent.in_text
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in NEVER:
        return True
    if tag in ("html", "body", "main"):
        return False
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if not value:
            continue
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key == "role" and value.strip().lower() in ROLES:
            return True
    return False


def _name(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """What class and id say: part, id (a section's whole id), full, comments, or nothing."""
    found = ""
    if tag in TEXT or tag in ("html", "body", "main"):
        return found
    for key, value in attrs:
        for token in (value or "").split() if key in ("class", "id") else ():
            words = [w.lower() for w in _NAME_WORDS.findall(token)]
            telling = [w for w in words if w not in NEUTRAL or w in NAMES]
            named = [w for w in telling if w in NAMES]
            if not named:
                continue
            if len(named) < len(telling):
                found = found or "part"
            elif key == "id" and tag in ("section", "article"):
                found = found if found in ("full", "comments") else "id-comments" if COMMENTS.intersection(named) else "id"
            else:
                found = "comments" if found == "comments" or COMMENTS.intersection(named) else "full"
    return found


class Tree(HTMLParser):
    """Builds nodes; off marks what its own tag or attributes rule out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            return
        if tag in BLOCK and self.at.tag != "body":
            self._end({"p"}, {"button", "td", "th", "li", "div", "section", "article", "table", "blockquote", "figure", "form"})
        if tag in CLOSES:
            self._end(CLOSES[tag], FENCES[tag])
        node = Node(tag, self.at, _unwanted(tag, attrs), "" if self.at.in_text else _name(tag, attrs))
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def _end(self, tags: set[str], fences: set[str]) -> None:
        """Close the nearest open element of these tags, unless a fence stands between."""
        node = self.at
        while node.parent is not None and node.tag not in fences | tags:
            node = node.parent
        if node.tag in tags and node.parent is not None:
            self.at = node.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in BLOCK and tag not in BLOCK:
                return  # an inline end tag does not close the block around it
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def _ordered(root: Node) -> list[Node]:
    """Nodes in page order, without what is off."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.off]
    return found


def _open_forms(root: Node) -> None:
    """A form with more text than the page has outside it, or around the page's article or main, is a plain container."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [p for p in node.parts if isinstance(p, Node) and (p.tag == "form" or p.tag not in NEVER)]
    chars, holds = {}, {}
    for node in reversed(order):
        own = [p for p in node.parts if isinstance(p, Node) and id(p) in chars]
        chars[id(node)] = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str)) + sum(chars[id(p)] for p in own)
        holds[id(node)] = node.tag in ("article", "main") or any(holds[id(p)] for p in own)
    for node in order:
        if node.tag == "form" and (2 * chars[id(node)] > chars[id(root)] or holds[id(node)] and not node.parent.off):
            node.off = False
            node.tag = "div"


def _spare(root: Node) -> None:
    """Put back elements that were ruled out by role or style but hold the page's article or main."""
    def inside(node: Node, tags: tuple[str, ...]) -> bool:
        todo = [node]
        while todo:
            n = todo.pop()
            for p in n.parts:
                if isinstance(p, Node):
                    if p.tag in tags and not p.off:
                        return True
                    if p.tag not in NEVER:
                        todo.append(p)
        return False

    _open_forms(root)
    todo = [root]
    within: dict[int, bool] = {id(root): False}
    while todo:
        node = todo.pop()
        article = within[id(node)] or node.tag in ("article", "main")
        for p in node.parts:
            if isinstance(p, Node):
                within[id(p)] = article
                if p.off and p.tag not in NEVER and inside(p, ("article", "main")):
                    p.off = False
                if p.tag == "footer" or p.tag == "header" and not article and not inside(p, ("article", "main")):
                    p.off = True
                if not p.off:
                    todo.append(p)


def _sum_up(node: Node) -> None:
    """Characters and tags of a node from those of its parts."""
    node.chars = node.tags = node.link_chars = node.link_tags = 0
    for p in node.parts:
        if isinstance(p, str):
            node.chars += sum(map(len, p.split()))
        elif not p.off:
            node.chars += p.chars
            node.tags += p.tags + 1
            node.link_chars += p.link_chars
            node.link_tags += p.link_tags + (p.tag == "a")
    if node.tag == "a":
        node.link_chars = node.chars


def _weigh(node: Node, share: float) -> None:
    """Composite density of a node; share is the body's link share."""
    node.density = 0.0
    if node.chars:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        node.density = max(0.0, c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base + 1e-9) if base > 1.0001 else c / t * math.log(c * t + math.e))


def _measure(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        _sum_up(node)
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        _weigh(node, share)
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.off)


def _best(nodes: list[Node]) -> Node:
    """The element with the largest density sum, grown to an enclosing article or main element."""
    best = up = max(nodes, key=lambda n: n.total)
    while up.parent is not None and best.total:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    return best


def _articles(nodes: list[Node]) -> list[Node]:
    """Outermost article and main elements without a full name; where all have one, their own names are taken off."""
    found, state = [], {id(nodes[0]): (False, False)}
    for n in nodes[1:]:
        inside, below_name = state[id(n.parent)]
        is_one = n.tag in ("article", "main")
        if is_one and not inside:
            n.name = "" if n.name == "part" else n.name
            found.append((n, below_name))
        state[id(n)] = inside or is_one, below_name or n.name not in ("", "part")
    if all(below_name or n.name for n, below_name in found):
        for n, below_name in found:
            n.name = n.name if below_name else ""
    return [n for n, _ in found if not n.name]


def _rule_out(root: Node) -> list[Node]:
    """Mark off what names together with densities rule out; the nodes left, measured."""
    nodes = _ordered(root)
    _measure(nodes)
    holds = {id(up) for n in _articles(nodes) for up in _upward(n)}
    named = [n for n in nodes if n.name]
    if not named:
        return nodes
    whole = {id(n): (n.total, n.chars, n.link_chars) for n in named}
    full = [n for n in named if n.name != "part"]
    for n in full:
        n.off = id(n) not in holds
    rest = _ordered(root)
    _measure(rest)
    best = _best(rest)
    inside, bar, nothing = set(map(id, _all(best))) if best.total else set(), best.total or root.density, not root.chars
    for n in full:
        total, chars, link_chars = whole[id(n)]
        if n.off and id(n) not in inside and 2 * link_chars <= chars and (chars if nothing else total > bar and "comments" not in n.name):
            n.off = False
    rest = _ordered(root)
    _measure(rest)
    best = _best(rest)
    path, inside = set(map(id, _upward(best))), set(map(id, _all(best))) if best.total else set()
    for n in named:
        total, chars, link_chars = whole[id(n)]
        if id(n) in path:
            n.off = False
        elif 2 * link_chars > chars:
            n.off = True
        elif n.off and id(n) in inside:
            if n.name.startswith("id"):
                n.off = any("comments" in x.name or x.tag == "form" for x in _all(n) if x is not n)
            else:
                n.off = n.tag in BLOCK and (n.name == "comments" or total < best.density)
    nodes = _ordered(root)
    _measure(nodes)
    return nodes


def _upward(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _all(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]


def _chosen(root: Node, nodes: list[Node]) -> list[Node]:
    """Elements whose blocks make up the article, in page order."""
    best = _best(nodes)
    if not best.total:
        return [root]
    path = list(_upward(best))
    threshold = min(n.density for n in path)
    share = root.link_chars / max(1, root.chars)
    before, after = [], []
    for below, node in zip(path, path[1:], strict=False):
        at = node.parts.index(below)
        before.append([n for n in _beside(node.parts[:at], share) if n.density >= threshold and n.chars > 2 * n.link_chars])
        after += [n for n in _beside(node.parts[at + 1:], share) if n.density >= threshold and n.chars > 2 * n.link_chars]
    return [n for found in reversed(before) for n in found] + [best] + after


def _beside(parts: list[Node | str], share: float) -> Iterator[Node]:
    """Blocks with text among parts of an element; a run of loose text and inline elements is one block."""
    run = Node("", None)
    for part in [*parts, None]:
        if part is not None and (isinstance(part, str) or part.tag not in BLOCK):
            run.parts.append(part)
            continue
        _sum_up(run)
        if run.chars:
            _weigh(run, share)
            yield run
        run = Node("", None)
        if part is not None and not part.off and part.chars:
            yield part


def _blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below a node, white space made single."""
    held: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            held.append(part)
            continue
        if part is not None and part.off:
            continue
        if part is not None and part.tag == "br":
            held.append(" ")
        edge = part is None or part.tag in BLOCK
        if edge:
            if text := " ".join("".join(held).split()):
                yield text
            held = []
        if part is not None:
            if edge:
                todo.append(None)
            todo += reversed(part.parts)
    if text := " ".join("".join(held).split()):
        yield text


def main_text(html: str | None) -> str:
    """Blocks of the article, two newlines between."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    _spare(tree.root)
    nodes = _rule_out(tree.root)
    return "\n\n".join(t for n in _chosen(tree.root, nodes) for t in _blocks(n))


def extract(html: Column) -> Column:
    """Main text of a column of whole pages."""
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x.as_py()) for x in batch], pa.string())

    texts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(texts, "string")(html)
