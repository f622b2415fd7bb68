"""Main text of a web page by composite text density.

The page is read into a tree of elements.  Parts that are never the article (navigation, headers,
footers, asides, forms, scripts, adverts, notices, comments; by element, role, or a word of the
class or id) are set aside, unless they hold the page's article themselves.  For each remaining
node, ``density`` is its characters per tag, adjusted by its share of link text and link tags; the
density sum of a node adds up the densities of its children.  The node with the largest sum is the
heart of the text; the smallest density on its path to the body is the threshold, and every node
that reaches it adds its own largest-sum subtree.  From the heart the choice widens to ancestors
whose other text is no list of links, so headings beside the paragraphs are kept.

Texts are joined block by block in page order.  Nothing is capped: the whole page is read.
Defined cases: null and empty pages have an empty text; broken markup is closed as browsers do, in
time that is linear in the page however deep it is nested; repeated rows are read one by one, and an
empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.S,
)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HEAD = frozenset("meta link title script style base noscript template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends open elements of these names, up to the nearest of the second set.
_LISTS, _TABLES = frozenset(("ul", "ol", "menu", "dir")), frozenset(("table",))
_ENDS = {
    "li": (frozenset(("li",)), _LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), _TABLES),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tbody": (frozenset(("thead", "tbody", "tfoot")), _TABLES),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
_ASIDE = frozenset(
    "script style noscript template head nav header footer aside form iframe svg math canvas object "
    "button select textarea dialog menu audio video fieldset title xmp noembed noframes search".split()
)
_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split()
)
#: Words of a class or id that name something other than the article.
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav "
    "navbar navigation menu header masthead footer sidebar aside widget toolbar breadcrumb "
    "breadcrumbs pager pagination cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist disqus discussion replies respond form search skip "
    "copyright teaser".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"))


class Node:
    __slots__ = ("name", "parent", "parts", "marked", "holds", "gone", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, marked: bool = False):
        self.name, self.parent, self.marked = name, parent, marked
        self.parts: list[Node | str] = []
        self.holds = self.gone = False
        self.density = self.total = 0.0


def _marked(attributes: str) -> bool:
    for key, *values in _MARKS.findall(attributes):
        value = "".join(values)
        if key.lower() == "role":
            if value.strip().lower() in _ROLES:
                return True
        elif any(w.lower() in _WORDS for w in _PARTS.findall(value)):
            return True
    return False


class _Open:
    """The open elements, from the root inwards, and at which depths each name is open.

    Looking a name up costs the same at any depth, so deeply nested and broken pages stay linear.
    """

    def __init__(self, root: Node):
        self.path = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.name, []).append(len(self.path))
        if node.name in _BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def cut(self, depth: int) -> None:
        """Close everything from ``depth`` on."""
        while len(self.path) > depth:
            name = self.path.pop().name
            self.depths[name].pop()
            if name in _BLOCK:
                self.blocks.pop()

    def deepest(self, names: frozenset) -> int:
        """Depth of the innermost open element with one of the names, 0 if there is none."""
        return max((d[-1] for n in names if (d := self.depths.get(n))), default=0)


def parse(page: str) -> Node:
    """The element tree of a page; its root is named ``html``."""
    root = Node("html", None)
    opened_now = _Open(root)
    body: Node | None = None
    at, size = 0, len(page)

    def to_body(attributes: str) -> None:
        nonlocal body
        if body is None:
            opened_now.cut(1)
            body = _child(root, "body", attributes)
            opened_now.push(body)
        else:
            opened_now.cut(2)

    def close(names: frozenset, stops: frozenset) -> None:
        depth = opened_now.deepest(names)
        if depth > opened_now.deepest(stops):
            opened_now.cut(depth)

    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            opened_now.path[-1].parts.append(page[at:])
            break
        if found.start() > at:
            if opened_now.path[-1].name in ("html", "head") and page[at : found.start()].strip():
                to_body("")
            opened_now.path[-1].parts.append(page[at : found.start()])
        at = found.end()
        ended, opened, attributes = found[1], found[2] or found[4], found[3] or found[5] or ""
        if ended:
            name = ended.lower()
            depth = opened_now.deepest(frozenset((name,)))
            # an inline end tag does not close blocks
            crossed = name not in _BLOCK and opened_now.blocks and opened_now.blocks[-1] > depth
            if depth and not crossed and name != "body":
                opened_now.cut(depth)
            continue
        if not opened:
            continue
        name = opened.lower()
        if name == "html":
            continue
        if name == "body":
            to_body(attributes)
            continue
        here = opened_now.path[-1]
        if here.name == "head" and name not in _HEAD or here is root and name != "head" and name not in _HEAD:
            to_body("")
        if name in _BLOCK:
            close(frozenset(("p",)), frozenset(("button", "td", "th", "table", "object")))
        if name in _ENDS:
            close(*_ENDS[name])
        node = _child(opened_now.path[-1], name, attributes)
        if name in _VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else size
            continue
        opened_now.push(node)
    return root


def _child(parent: Node, name: str, attributes: str) -> Node:
    node = Node(name, parent, bool(attributes) and _marked(attributes))
    parent.parts.append(node)
    return node


def _measure(root: Node) -> list[Node]:
    """Set aside what is no article and count characters, tags and links; nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for node in reversed(order):
        inner = [p for p in node.parts if isinstance(p, Node)]
        node.holds = any(p.holds for p in inner) or node.name in ("article", "main") and not node.marked
        odd = node.name in _ASIDE or node.marked and node.name not in ("html", "body", "main")
        node.gone = odd and (not node.holds or node.name in _RAW or node.name == "head")
        if node.gone:
            node.holds = False
        inner = [p for p in inner if not p.gone]
        own = 0
        for i, part in enumerate(node.parts):
            if isinstance(part, str):
                if "&" in part:
                    node.parts[i] = part = html.unescape(part)
                own += len("".join(part.split()))
        node.chars = own + sum(p.chars for p in inner)
        node.tags = len(inner) + sum(p.tags for p in inner)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, 1
        else:
            node.link_chars = sum(p.link_chars for p in inner)
            node.link_tags = sum(p.link_tags for p in inner)
    return order


def _densities(nodes: list[Node], body: Node) -> None:
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        c, t = node.chars, max(node.tags, 1)
        if c:
            links, link_tags, plain = max(node.link_chars, 1), max(node.link_tags, 1), max(c - node.link_chars, 1)
            base = math.log(c / plain * node.link_chars + share * c + math.e)
            adjusted = math.log(max(c / links * t / link_tags, 1.0)) / max(math.log(base), 1.0)
            node.density = c / t * adjusted
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.gone)


def _inside(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.gone)
    return out


def _widened(heart: Node, body: Node) -> Node:
    """The highest ancestor whose text beside the heart is no list of links (below the body: only
    headings may stand beside it)."""
    while heart is not body and heart.parent is not None:
        up = heart.parent
        chars, links = up.chars - heart.chars, up.link_chars - heart.link_chars
        if up is body:
            beside = [p for p in up.parts if p is not heart and not (isinstance(p, Node) and p.gone)]
            plain = all(
                (p.name in _HEADINGS or not p.chars) if isinstance(p, Node) else not p.strip()
                for p in beside
            )
            if not plain:
                break
        elif links > 0.3 * max(chars, 1):
            break
        heart = up
    return heart


def main_nodes(root: Node) -> list[Node]:
    """The subtrees that make up the main text, in page order, none inside another."""
    nodes = _measure(root)
    body = next((n for n in nodes if n.name == "body"), root)
    shown = _inside(body)
    _densities(shown, body)
    if not body.chars:
        return []
    heart = max(shown, key=lambda n: n.total)
    if not heart.total:
        return [body]
    threshold, node = heart.density, heart
    while node is not None:
        threshold = min(threshold, node.density)
        if node is body:
            break
        node = node.parent
    best: dict[int, Node] = {}
    for node in reversed(shown):  # children before parents
        top = max((best[id(p)] for p in node.parts if isinstance(p, Node) and not p.gone), key=lambda n: n.total, default=node)
        best[id(node)] = node if node.total >= top.total else top
    chosen = {id(_widened(heart, body))} | {id(best[id(n)]) for n in shown if n.density >= threshold}
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if id(node) in chosen:
            out.append(node)
        else:
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.gone)
    return out


def _blocks(node: Node, out: list[list[str]]) -> None:
    stack: list = [node]
    while stack:
        part = stack.pop()
        if part is None:
            out.append([])
        elif isinstance(part, str):
            out[-1].append(part)
        elif part.gone:
            continue
        elif part.name == "br":
            out[-1].append(" ")
        elif part.name in _BLOCK:
            out.append([])
            stack.append(None)
            stack.extend(reversed(part.parts))
        else:
            stack.extend(reversed(part.parts))


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by newlines."""
    if not page:
        return ""
    out: list[list[str]] = [[]]
    for node in main_nodes(parse(page)):
        out.append([])
        _blocks(node, out)
    texts = (" ".join("".join(block).split()) for block in out)
    return "\n".join(t for t in texts if t)


@arrow_udf(StringType())
def extract(pages: pa.Array) -> pa.Array:
    """``main_text`` of a column of pages."""
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())
