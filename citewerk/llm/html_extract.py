"""Main text of web pages by composite text density.

A page is read into a DOM (implied end tags, unclosed tags and raw-text elements as browsers take
them). Page furniture goes first: navigation, page headers and footers, sidebars, notices,
adverts, forms, scripts, hidden parts and reader comments, told by tag, role, class or id. A class
or id tells it by a whole token (`sidebar`) or a compound of known parts (`site-footer`), never by
one that modifies another element (`has-sidebar`, `no-comments`); and a node that holds an article
or main element, or the centre of a page without these, is no furniture by its name. For each node
left, with C characters, T tags, LC characters and LT tags in links,

    density = C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LC_body / C_body * C + e))

(zero denominators count as 1; without links on the page it is C / T). The subtree with the
greatest sum of its children's densities is the centre of the content. The smallest density on the
path from the body to it is the threshold; every other node that reaches it contributes the
greatest-sum subtree below it, and headings beside the path belong to it. This holds on every
page; an article element is one more candidate: it counts whole if its density reaches the threshold.

Text comes out in page order, one block for each block element: character references decoded,
white space one blank, blocks joined by an empty line.

Defined results: null or empty html gives empty text; a page without markup is one block; pages
that repeat give equal rows; nothing is cut, whatever the length or depth.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import fresh, pieces, texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^\W\d_]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: A start tag on the left ends an open element on the right.
ENDS = {name: frozenset(["p"]) for name in BLOCK} | {
    "li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]),
    "tr": frozenset(["tr", "td", "th", "p"]), "td": frozenset(["td", "th", "p"]),
    "th": frozenset(["td", "th", "p"]), "option": frozenset(["option"]),
}
#: Implied ends do not reach beyond these.
WALLS = frozenset("ul ol dl table article section div aside nav body html td th".split())
FURNITURE = frozenset(
    "nav aside footer form script style noscript template svg iframe object button select textarea "
    "input dialog menu head title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
WORDS = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notification popup modal overlay newsletter subscribe subscription "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "respond disqus share sharing social related login signup search widget pagination pager".split()
)
#: A token of several parts names furniture if all parts are here or in WORDS, and one is in WORDS.
PARTS = frozenset(
    "site page main top bottom left right primary secondary side global mobile desktop header container "
    "wrapper wrap box bar block area section list item items link links button buttons inner outer posts post "
    "entry article slot form icon icons toggle thread unit group panel title author".split()
)
#: A header is named by these beside the word itself.
HEADER_PARTS = frozenset("site page main top global mobile desktop container wrapper wrap inner outer bar".split())
#: Parts that tell of another element.
MODIFIERS = frozenset("has no with without not is hide show enable disable".split())
#: What these name is dropped though it holds articles, unless nothing else on the page has text.
REPLIES = frozenset("comment comments respond disqus cookie cookies consent gdpr".split())
#: Never taken for furniture by class or id, articles only by a class that is one word of WORDS.
CONTENT = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "named", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, named: frozenset[str] = frozenset()):
        self.tag = tag
        #: The words that name it furniture.
        self.named = named
        self.parts: list[Node | str] = []


def _is_furniture(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attributes.strip() or tag in CONTENT:
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        name = match[1].lower()
        value = (match[2] or match[3] or match[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def furniture_words(tag: str, attributes: str, in_article: bool) -> frozenset[str]:
    """The words of class and id that name an element page furniture."""
    found: set[str] = set()
    if not attributes.strip() or tag in CONTENT:
        return frozenset()
    for match in _ATTRIBUTE.finditer(attributes):
        if match[1].lower() not in ("class", "id"):
            continue
        for token in (match[2] or match[3] or match[4] or "").lower().split():
            if token in WORDS:
                found.add(token)
            if tag == "article":
                continue
            parts = set(_PART.findall(token))
            if parts & MODIFIERS:
                continue
            if parts & WORDS and parts <= WORDS | PARTS:
                found |= parts & WORDS
            elif "header" in parts and parts - {"header"} <= HEADER_PARTS and not in_article:
                found.add("header")
    return frozenset(found)


def parse(page: str) -> Node:
    """The body of the page, furniture left out."""
    root, named = _read(page)
    if named:
        _drop_named(root)
    return root


def _drop_named(root: Node) -> None:
    """Take out the nodes that class or id names furniture and that do not hold the content."""
    nodes = _ordered(root)
    _measure(nodes)
    parents = {id(node): parent for node, parent in nodes}
    articles = [n for n, _ in nodes if n.tag in ("article", "main") and n.chars and not n.named]
    replies = {id(n) for n, _ in nodes if n.named & REPLIES}
    inside = set(replies)  # of comments and the like
    for node, parent in nodes:
        if parent is not None and id(parent) in inside:
            inside.add(id(node))
    outside = [n for n, _ in nodes if id(n) not in inside]
    chosen = [n for n in articles if id(n) not in inside]
    if not chosen and any(isinstance(p, str) and p.strip() for n in outside for p in n.parts):
        # the centre by sums without what is inside
        sums = [sum(p.density for p in n.parts if isinstance(p, Node) and id(p) not in inside) for n in outside]
        chosen = [outside[max(range(len(sums)), key=sums.__getitem__)]]
    elif not chosen:
        chosen = articles or [max(nodes, key=lambda n: n[0].total)[0]]
    held: set[int] = set()
    for node in chosen:
        while node is not None and id(node) not in held:
            held.add(id(node))
            node = parents[id(node)]
    for node, _ in nodes:
        if any(isinstance(p, Node) and p.named and id(p) not in held for p in node.parts):
            node.parts = [p for p in node.parts if not isinstance(p, Node) or not p.named or id(p) in held]


def _read(page: str) -> tuple[Node, bool]:
    """The body without what is furniture by tag, role or state, and whether names tell of more."""
    root = Node("body")
    stack: list[Node] = [root]
    skipped = 0  # depth of the stack at which furniture began
    articles = 0
    any_named = False
    at, size = 0, len(page)

    def close(down_to: int) -> None:
        nonlocal skipped, articles
        while len(stack) > down_to:
            articles -= stack.pop().tag in ("article", "main")
        if skipped and len(stack) < skipped:
            skipped = 0

    while at < size:
        match = _TOKEN.search(page, at)
        text = page[at : match.start() if match else size]
        if text and not skipped:
            stack[-1].parts.append(references.unescape(text))
        if match is None:
            break
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        ending = match[1] if match[2] else match[4]
        attributes = (match[3] if match[2] else match[6]) or ""
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in ("html", "body"):
            continue
        ended = ENDS.get(tag)
        if ended:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    close(depth)
                elif stack[depth].tag in WALLS:
                    break
        node = Node(tag, frozenset() if skipped else furniture_words(tag, attributes, articles > 0))
        any_named = any_named or bool(node.named)
        drop = not skipped and _is_furniture(tag, attributes, articles > 0)
        if not skipped and not drop:
            stack[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        stack.append(node)
        articles += tag in ("article", "main")
        if drop:
            skipped = len(stack)
        if tag == "head":
            skipped = skipped or len(stack)
    return root, any_named


def _ordered(root: Node) -> list[tuple[Node, Node | None]]:
    """Nodes with their parents, parents first."""
    out, waiting = [], [(root, None)]
    while waiting:
        node, parent = waiting.pop()
        out.append((node, parent))
        waiting += [(p, node) for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def _measure(nodes: list[tuple[Node, Node | None]]) -> None:
    for node, _ in nodes:
        node.chars = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.tags = node.link_tags = node.link_chars = 0
        node.total = 0.0
    for node, parent in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
        if parent is not None:
            parent.chars += node.chars
            parent.tags += node.tags + 1
            parent.link_chars += node.link_chars
            parent.link_tags += node.link_tags + (node.tag == "a")
    body = nodes[0][0]
    share = body.link_chars / max(1, body.chars)
    for node, parent in nodes:
        node.density = node.chars / max(1, node.tags)
        if share and node.chars:
            around = node.chars / max(1, node.chars - node.link_chars) * node.link_chars
            base = math.log(math.log(around + share * node.chars + math.e))
            plain = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density *= math.log(max(plain, 1.0)) / max(base, 1e-6)
        if parent is not None:
            parent.total += node.density


def content_nodes(root: Node) -> set[int]:
    """Ids of the nodes whose whole subtrees are content."""
    nodes = _ordered(root)
    _measure(nodes)
    parents = {id(node): parent for node, parent in nodes}
    centre = max(nodes, key=lambda n: n[0].total)[0]
    path = [centre]
    while path[-1] is not root:
        path.append(parents[id(path[-1])])
    threshold = min(node.density for node in path)
    # the greatest sum below each node, children before parents
    best: dict[int, Node] = {}
    for node, parent in reversed(nodes):
        own = best.get(id(node))
        if own is None or node.total >= own.total:
            own = best[id(node)] = node
        if parent is not None:
            other = best.get(id(parent))
            if other is None or own.total >= other.total:
                best[id(parent)] = own
    chosen = {id(centre)}
    chosen |= {id(n) for n, _ in nodes if n.tag == "article" and n.density >= threshold}
    for node in path[1:]:
        chosen |= {id(p) for p in node.parts if isinstance(p, Node) and p.tag in HEADINGS}
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.density >= threshold:
            chosen.add(id(best[id(node)]))
            waiting += [p for p in node.parts if isinstance(p, Node)]
    return chosen


def main_text(page: str) -> str:
    """Blocks of the content, joined by empty lines."""
    root = parse(page)
    chosen = content_nodes(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    # a walk with an own stack: pages may be nested deeper than Python calls
    waiting: list[tuple[object, bool]] = [(root, False)]
    while waiting:
        part, inside = waiting.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            if inside:
                line.append(part)
        else:
            inside = inside or id(part) in chosen
            if part.tag in BLOCK:
                flush()
                waiting.append((None, False))
            elif part.tag == "br":
                line.append(" ")
            waiting += [(p, inside) for p in reversed(part.parts)]
    flush()
    return "\n\n".join(blocks)


def extract(
    pages: DataFrame, keep: list[str], html_col: str = "html"
) -> DataFrame:
    """The columns `keep` of each page with its text and n_chars."""
    text, count = fresh(keep, "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            found = [main_text(page) for page in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(keep)],
                    pa.array(found, pa.string()),
                    pa.array(list(map(len, found)), pa.int64()),
                ],
                names=[*keep, text, count],
            )

    columns = [f"`{n}` {pages.schema[n].dataType.simpleString()}" for n in keep]
    chosen = pages.select(*[F.col(f"`{n}`") for n in keep], F.col(f"`{html_col}`").alias("html"))
    return chosen.mapInArrow(run, ", ".join([*columns, f"{text} string, {count} long"]))
