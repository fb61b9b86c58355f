"""Operator 10: main text of HTML pages from parser events.

The standard library's event parser turns a page into lines, one per block element
with text. Each line has a ratio of text to tags; the ratios are smoothed with a
Gaussian and a threshold (a share of their deviation) clusters the lines into
content and rest. The content region is the element that holds the weight of the
content lines: the article elements or the main element if they do, else the least element
around all of them. All lines of the region are kept, short ones too, but for those inside
elements that are menus, headers, footers, forms, adverts, comments and the like. An
element that only its class, id or role marks so is kept if it holds most of the text.

One page is one row's work in one narrow stage; nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements without content, elements whose text is not shown,
#: elements that open a block, and elements that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video map select datalist textarea".split())
BOILER = frozenset("nav header footer aside form button dialog menu label fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "body", "html", "caption", "dd", "dt", "legend", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
#: Words of class, id and role values that mark elements outside the article.
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsbygoogle|adbox|adslot|adunit|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:igation|bar)?|menu|breadcrumbs?|header|masthead|footer|sidebar|side|rail|widget|related|recommend(?:ed|ations)?|share|sharing|social|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|search|toolbar|pagination|pager|tags?|skip|complementary|contentinfo|dialog|form|topbar|bottombar|disclaimer)(?:$|[\s_-]|\d)",
    re.I,
)
ROOTS = frozenset(["article", "main"])
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Names that tell of an element beside the one that they are on.
ABOUT_OTHERS = re.compile(r"^(?:has|with|without|no|is)[-_]", re.I)
_REPLY = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none")


class _Node:
    __slots__ = ("tag", "parent", "depth", "hard", "named", "hidden", "root", "marked", "own", "held", "boiler", "inside")

    def __init__(self, tag, parent, hard=False, named=False, hidden=False, root=False):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.hard, self.named, self.root = hard, named, root
        self.hidden = hidden or bool(parent and parent.hidden)
        self.marked = hard or named or bool(parent and parent.marked)
        self.own = self.held = 0
        self.boiler = self.inside = False


class Events(HTMLParser):
    """Collects lines: (text, tags, node), and the nodes in page order, parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = _Node("#", None)
        self.nodes = [self.node]
        self.open: dict[str, list[_Node]] = {}  # of each tag the open elements, outermost first
        self.open_blocks: list[_Node] = []
        self.lines: list[tuple[str, int, _Node]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.owner = self.node

    def flush_line(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.lines.append((text, self.tags, self.owner))
                self.tags = 0
            self.parts = []

    def _push(self, node: _Node) -> None:
        self.node = node
        self.nodes.append(node)
        self.open.setdefault(node.tag, []).append(node)
        if node.tag in BLOCK:
            self.open_blocks.append(node)

    def _pop_to(self, node: _Node) -> None:
        while self.node.depth >= node.depth:  # each element is popped once
            self.open[self.node.tag].pop()
            if self.node.tag in BLOCK:
                self.open_blocks.pop()
            self.node = self.node.parent

    def _close(self, tag: str, stop=()) -> None:
        """End the innermost open ``tag`` unless an element of ``stop`` stands inside of it."""
        mine = self.open.get(tag)
        if mine and not any(self.open.get(x) and self.open[x][-1].depth > mine[-1].depth for x in stop):
            self._pop_to(mine[-1])

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush_line()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close("p", ("table", "td", "th", "article", "section", "div", "main", "body", "li", "button", "object"))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            for name in same:
                self._close(name, ("ul", "ol", "dl", "table", "select", "menu", *(["tr"] if tag in ("td", "th") else [])))
        names = [n for k, v in attrs if v and k in ("class", "id", "role") for n in v.split() if not ABOUT_OTHERS.search(n)]
        words = _CAMEL.sub("-", " ".join(names))
        keys = {k for k, _ in attrs}
        hidden = tag in HIDDEN or "hidden" in keys or any(k == "style" and v and _NOT_SHOWN.search(v) for k, v in attrs)
        is_root = tag in ROOTS or any(k == "role" and v == "main" for k, v in attrs)
        named = tag not in ("html", "body") and not is_root and bool(words) and bool(BOILER_WORDS.search(words))
        # a reader comment may be an article element too
        hard = tag in BOILER or (is_root and tag != "main" and bool(words) and bool(_REPLY.search(words)))
        self._push(_Node(tag, self.node, hard, named, hidden, is_root and not hard))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.node.tag == tag and tag in ("svg", "math", "path", "use", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush_line()
        mine = self.open.get(tag)
        # inline end tags do not close blocks around them
        if tag not in VOID and mine and (tag in BLOCK or tag in HIDDEN or not self.open_blocks or self.open_blocks[-1].depth < mine[-1].depth):
            self._pop_to(mine[-1])

    def handle_data(self, data):
        if self.node.hidden:
            return
        if not self.parts:
            if data.isspace():
                return
            self.owner = self.node
        elif self.node.marked != self.owner.marked:
            self.flush_line()
            self.owner = self.node
        self.parts.append(data)


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def _events(html: str) -> Events:
    """Parser events of the whole page; a declaration that the parser gives up on is skipped as a comment is."""
    while True:
        parser = Events()
        try:
            parser.feed(html)
            parser.close()
        except AssertionError:
            html, before = re.sub(r"<!\[[^>]*>", " ", html), html
            if html == before:
                html = html.replace("<!", " ")
            continue
        parser.flush_line()
        return parser


def _sum_up(nodes: list) -> None:
    for n in nodes:
        n.held = n.own
    for n in reversed(nodes):  # children come after their parents
        if n.parent is not None:
            n.parent.held += n.held


def content_lines(html: str, sigma: float = 1.0, share: float = 0.5) -> list[str]:
    """The text of the content region's lines, in page order."""
    parser = _events(html)
    nodes, every = parser.nodes, parser.lines
    # what a class name marks is boilerplate unless it holds article or main elements, or, where the page has
    # none, most of the text that no element marks
    for n in nodes:
        n.boiler = n.hard or bool(n.parent and n.parent.boiler)
        n.own = int(n.root and not n.boiler)
    _sum_up(nodes)
    if not nodes[0].held:
        for text, _, n in every:
            n.own += 0 if n.boiler else len(text)
        _sum_up(nodes)
        least = nodes[0].held / 2
    else:
        least = 0
    for n in nodes:
        n.boiler = n.hard or (n.named and n.held <= least) or bool(n.parent and n.parent.boiler)
    lines = [x for x in every if not x[2].boiler]
    if not lines:
        return []
    smoothed = smooth(np.array([len(text) / max(1, tags) for text, tags, _ in every]), sigma)
    content = [not x[2].boiler and s > share * float(smoothed.std()) for x, s in zip(every, smoothed, strict=True)]
    if not any(content):
        content = [not x[2].boiler for x in every]
    for n in nodes:
        n.own = 0
    for (text, _, n), c in zip(every, content, strict=True):
        n.own += len(text) if c else 0
    _sum_up(nodes)
    total = nodes[0].held
    # article elements that hold most of the content, all outermost ones of them, or else a main element;
    # without either the least element around all content lines
    for kind in ("article", "main"):
        tops = []
        for n in nodes:
            n.inside = bool(n.parent and n.parent.inside)
            if n.root and (n.tag == "article") == (kind == "article") and not n.boiler and not n.inside:
                n.inside = True
                tops.append(n)
        if sum(n.held for n in tops) * 2 > total:
            return [x[0] for x in lines if x[2].inside]
    region = max((n for n in nodes if n.held == total), key=lambda n: n.depth)
    while region.tag in ("p", "b", "i", "em", "strong", "span", "a", "li", "td", "tr") and region.parent is not None:
        region = region.parent
    for n in nodes:
        n.inside = n is region or bool(n.parent and n.parent.inside)
    return [x[0] for x in lines if x[2].inside]


def main_text(html: str | None) -> str:
    """Blocks joined by one space; references decoded, white space inside a block one space."""
    return " ".join(content_lines(html)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Null or empty html, and pages without content, give an empty text. Null ids and
    urls pass through; repeated rows are extracted alike; extra columns are not
    read; an empty table gives no rows. Long and badly nested pages take time and
    memory in proportion to their length; markup that the parser gives up on is skipped.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
