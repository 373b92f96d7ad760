"""Main text of web pages by composite text density.

Every node of a page's tree has the number of its characters and tags, and of those inside links. Its density is
characters per tag, lowered by a logarithm whose base and argument follow the share of link text. The block whose child
blocks' densities sum highest holds the content. The density of the thinnest block on the path from it to the body is
the threshold: the highest parent on that path that has a block as dense beside the path is taken instead (the body only
if that one's children sum to a third as much); of what is beside the path thinner blocks with links are left out, as
are lists of links inside.

Before that, elements that a page uses for something else than its text go, by their tags (NOT_TEXT) and by words in
their class, id and role (NOT_TEXT_NAMES): the named furniture of a page, which can be as dense as its text. A name that
only begins with such a word, as `search-results` does, removes nothing that holds the densest block, and one that says
what an element has or lacks, as `no-sidebar` does, removes nothing. That an element is an article or main decides
nothing, but that names on it and around it count less.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from convspark.llm.common import only

# Fixed values of HTML: elements without an end, whose content is not markup, and that start and end lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that a page uses for something else than its text.
NOT_TEXT = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input label iframe object embed svg canvas audio video "
    "map dialog menu title".split()
)
#: Words in class, id and role that mark something else than the text. Only whole words of such names count.
NOT_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "sidebar sidebars rail widget widgets aside complementary footer header masthead comment comments commentlist reply replies discussion disqus respond "
    "share sharing social related recommended recommendations trending toolbar skip contentinfo search dialog alertdialog form tags".split()
)
#: Words of a name that say what an element has or lacks, not what it is.
MODIFIERS = frozenset("no not non has have with without".split())
#: What readers write can be longer than the text: these words remove wherever they stand in a name.
READERS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
ARTICLE_NAMES = frozenset("ad advert advertisement sponsored promo comment reply related recommended".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are left out if they hold links alone.
LISTS = frozenset("ul ol dl div section table".split())
#: Starting one of these ends an open element of the second column in the same parent.
ENDS = {"p": frozenset("p".split()), "li": frozenset(["li"]), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(["option"])}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
_NAME = re.compile(r"[\s\"'/](class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|\Z)|\saria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


#: How an element is marked as something else than text.
NONE, WEAK, STRONG = 0, 1, 2


class Node:
    __slots__ = ("tag", "parts", "parent", "dropped", "weak", "block", "open", "chars", "tags", "link_chars", "link_tags", "sum", "density")

    def __init__(self, tag: str, parent: Node | None, mark: int):
        self.tag, self.parent, self.dropped, self.weak, self.parts = tag, parent, mark > 0, mark == WEAK, []
        # the block around it, and how many inline elements a block has open of each tag, so that no end looks in vain
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.open: dict[str, int] = {}
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = self.density = 0.0


def _marked(tag: str, attributes: str, inside: bool) -> int:
    """Whether an element is something else than text; inside: of an article, whose own header counts as text."""
    if tag in NOT_TEXT or tag == "header" and not inside:
        return STRONG
    if not attributes or tag in ("html", "body", "main"):
        return NONE
    if _HIDDEN.search(attributes):
        return STRONG
    names = NOT_TEXT_NAMES
    if tag == "article":  # named after what stands in it or beside it, too
        names = ARTICLE_NAMES
    elif inside:
        names = NOT_TEXT_NAMES - {"header"}
    mark = NONE
    for m in _NAME.finditer(" " + attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [w.lower() for w in _WORD.findall(name)]
            if not names.isdisjoint(words) and MODIFIERS.isdisjoint(words):
                if words[-1] in names or not (names & READERS).isdisjoint(words):
                    return STRONG
                mark = WEAK
    return mark


def parse(page: str) -> Node:
    """The tree of a page, however broken: open elements end with their parent, stray ends are passed over."""
    root = node = Node("html", None, NONE)
    articles, seen, at, n = 0, False, 0, len(page)
    blocks: dict[str, int] = {}  # open ones by tag

    def close(last: Node, node: Node) -> Node:
        """End all from node up to last; the parent of that."""
        nonlocal articles
        while True:
            articles -= node.tag in CONTENT
            counts = blocks if node.block is node else node.block.open
            counts[node.tag] -= 1
            if node is last:
                return node.parent
            node = node.parent

    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            node.parts.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            # an inline end does not end blocks
            if (blocks if tag in BLOCK else node.block.open).get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent if tag not in BLOCK or up.block is up else up.block
                node = close(up, node)
            continue
        ends = ENDS.get(tag) or (ENDS["p"] if tag in BLOCK else None)
        while ends and node.block is not root and node.block.tag in ends:
            node = close(node.block, node)
        if ends and any(node.block.open.get(t) for t in ends):
            up = node
            while up.tag not in ends:
                up = up.parent
            node = close(up, node)
        own = Node(tag, node, _marked(tag, m[3], articles > 0))
        node.parts.append(own)
        if tag in CONTENT and not own.dropped and not seen:
            seen, up = True, node
            while up is not None:  # what holds the text may be named after what stands beside it
                up.dropped = up.dropped and up.tag in NOT_TEXT
                up = up.parent
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            if tag in ("textarea", "title") and end:
                own.parts.append(html.unescape(page[m.end() : end.start()]))
        elif tag not in VOID and not m[3].endswith("/"):
            counts = blocks if own.block is own else own.block.open
            counts[tag] = counts.get(tag, 0) + 1
            articles += tag in CONTENT
            node = own
    return root


def _walk(root: Node) -> Iterator[Node]:
    """Kept nodes, parents first."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.dropped)


def measure(root: Node) -> list[Node]:
    """Set counts, densities and density sums of all kept nodes; the nodes, children first."""
    nodes = list(_walk(root))[::-1]
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for p in node.parts:
            if isinstance(p, Node):
                if not p.dropped:
                    node.chars += p.chars
                    node.tags += p.tags + 1
                    node.link_chars += p.link_chars
                    node.link_tags += p.link_tags + (p.tag == "a")
            else:
                node.chars += len("".join(p.split()))
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        chars, tags, links, link_tags = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if chars:
            base = chars / max(1, chars - node.link_chars) * links + share * chars + e
            node.density = chars / tags * log(max(1.0, chars / links * tags / link_tags)) / log(log(base))
        # inline elements are part of their block
        node.sum = sum(p.density if p.tag in BLOCK else p.sum for p in node.parts if isinstance(p, Node) and not p.dropped)
    return nodes


def _blocks(top: Node, core: Node, threshold: float) -> list[str]:
    """Texts between block borders in page order, white space folded."""
    out, line = [], []
    inside = {id(core)}  # the core and what holds it
    up = core
    while up is not top:
        up = up.parent
        inside.add(id(up))

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    def thin(p: Node, beside: bool) -> bool:
        if p.density >= threshold or not p.chars or p.tag not in BLOCK:
            return False
        if beside:
            return p.tag not in HEADINGS and (p.link_chars > 0 or p.parent.tag == "body")
        return p.link_chars == p.chars and p.link_tags > 1 and p.tag in LISTS

    stack: list = [(top, top is not core)]
    while stack:
        p, beside = stack.pop()
        if p is None:
            end()
        elif isinstance(p, str):
            line.append(p)
        elif p.tag == "br":
            line.append(" ")
        elif id(p) in inside or not (p.dropped or thin(p, beside)):
            if p.tag in BLOCK:
                end()
                stack.append((None, False))
            around = id(p) in inside and p is not core
            stack.extend((x, around) for x in reversed(p.parts))
    end()
    return out


def _core(root: Node, nodes: list[Node]) -> Node:
    core = max(reversed(nodes), key=lambda x: x.sum)
    return root if core.sum == 0 else core.block


def _settled(root: Node) -> list[Node]:
    """Measured nodes, without the weakly marked ones but for those that hold the densest block of all."""
    weak, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.weak and node.dropped:
            weak.append(node)
        if not node.dropped or node.weak:
            stack.extend(p for p in node.parts if isinstance(p, Node))
    if not weak:
        return measure(root)
    for node in weak:
        node.dropped = False
    up, holders = _core(root, measure(root)), set()
    while up is not None:
        holders.add(id(up))
        up = up.parent
    for node in weak:
        node.dropped = id(node) not in holders
    return measure(root)


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    nodes = _settled(root)
    if not root.chars:
        return ""
    core = _core(root, nodes)
    threshold, up = core.density, core
    while up is not None and up.tag != "html":
        if up.density:
            threshold = min(threshold, up.density)
        up = up.parent
    top = up = core
    while up.parent is not None and up.tag != "body":
        beside = [p for p in up.parent.parts if isinstance(p, Node) and p is not up and not p.dropped and p.tag in BLOCK and p.density >= threshold]
        if any(up.parent.tag not in ("body", "html") or 3 * p.sum >= core.sum for p in beside):
            top = up.parent
        up = up.parent
    return "\n".join(_blocks(top, core, threshold))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(p.as_py()) for p in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.large_string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page, from its whole html.

    pages: page_id long, url, html. Blocks are joined by line feeds, white space in a block is one space, character
    references are decoded. A null or empty page, and one without text, has an empty text. Rows that repeat a page_id
    each give a row. Other columns of pages are not read.
    """
    return only(pages, "page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
