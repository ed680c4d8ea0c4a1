"""Main text of web pages by composite text density.

A page becomes a tree of its elements; scripts, styles and controls have no text. For
each node its characters C and tags T are counted, those of links (LC, LT) apart, 0
counting as 1; the composite density is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LCb / Cb * C + e))

where b is the body, so navigation scores low. A node's density sum adds the
densities of its children (text of its own is a child without tags). The node of the
largest sum is the core; the smallest density on the path from it to the body is the
threshold. Walking down from the body, each subtree that reaches the threshold marks
its own node of the largest sum, so an article in several containers is found whole.
Blocks between two marks, running text after the last and a heading above the first
belong to it; a mark is widened to the <article> or <main> that it lies in.

Names are hints that only take away what density does not contradict. An element
whose tag (nav, aside, footer, ...), class, id or role names a part that is no main
text is left out unless the core lies in it. The core is sought outside such parts
first; it is taken from inside where there is little text outside (a wrapper called
"no-sidebar", a form around the page). Where only a class, id or role names a part
inside the marks, its size, its links or its density must agree.

Defined results: null or empty html, and pages without text, give an empty text;
unclosed and stray tags are tolerated as browsers do in the common cases (p, li,
table cells and options close each other); a page without body is its own body.
Pages are independent of each other, repeated rows give repeated rows, an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from topicloom.llm._spark import small_batches, tidy

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without text of the page.
DROP = frozenset("script style noscript template iframe object embed svg math canvas head title button select textarea input noembed noframes audio video".split())
#: Elements that are no main text, unless the page's core lies in them.
PARTS = frozenset("nav menu footer aside form dialog".split())
#: Words of class, id and role values that name such parts.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe sidebar side aside rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer foot copyright comment comments reply replies respond disqus discussion social share sharing related recommended recommendations toolbar skip search login signup complementary contentinfo alert".split()
)
#: Classes that begin or end so say how a page looks, not what an element is.
BEFORE, AFTER = frozenset("has with without no".split()), frozenset("open closed".split())
#: Words of names that say what shape an element has; they may follow the word that says what it is.
SHAPE = frozenset(
    "area article articles bar block body box button buttons col column container content count entry form group icon icons inline inner item items left line link links list main mobile module news outer page panel post posts region right row section site slot stories story text title top bottom unit wrap wrapper".split()
)
#: A "header" of these, or inside an article, is its heading.
OF_TEXT = frozenset("entry post article story".split())
COMMENTS = frozenset("comment comments".split())
#: A block of which this share is links is no running text.
LINK_PART = 0.5
#: The core is sought outside named parts if the text there is at least this share of the largest such part's.
REST = 0.25
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks of running text; those that follow a marked one belong to it.
RUNNING = HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())
#: A start tag of the key ends these open elements, up to the given ancestors.
CLOSES = {
    **dict.fromkeys(BLOCK - {"body", "html", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, (("p",), ("table", "td", "th", "button", "object"))),
    "li": (("li", "p"), ("ul", "ol", "menu", "dir", "table")),
    "dt": (("dt", "dd", "p"), ("dl", "table")),
    "dd": (("dt", "dd", "p"), ("dl", "table")),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th", "p"), ("table",))),
    "option": (("option",), ("select",)),
}


class Node:
    __slots__ = ("chars", "density", "density_sum", "drop", "items", "link_chars", "link_tags", "marked", "named", "parent", "tag", "tags")

    def __init__(self, tag: str, parent: Node | None, drop: bool, named: int = 0):
        self.tag, self.parent, self.drop, self.named, self.items, self.marked = tag, parent, drop, named, [], False
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.density_sum = 0.0

    def nodes(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node) and not x.drop]


#: What speaks against a node: nothing, a class, id or role, its tag, or that it holds reader comments.
NAME, TAG, COMMENT = 1, 2, 3


def _kind(words: list[str]) -> set[str]:
    """The words of a name that may name a part: the last one that says more than a shape, and noisy words that are with it."""
    said = words[:]
    while len(said) > 1 and said[-1] in SHAPE and said[-1] not in NOISE:
        said.pop()
    return NOISE.intersection(said) if said[-1] in NOISE else set()


def _named(tag: str, attrs: str, inside_article: bool) -> int:
    """Whether tag, class, id or role name a part that is seldom main text; an article is one only as a comment."""
    if tag in ("html", "body", "main", "#root") or tag == "article" and "comment" not in attrs.lower():
        return 0
    said = TAG if tag in PARTS or tag == "header" and not inside_article else 0
    for m in _ATTR.finditer(attrs):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = re.findall("[a-z]+", name)
            if not words or len(words) > 1 and (words[0] in BEFORE or words[-1] in AFTER):
                continue
            noisy = _kind(words)
            if tag == "article":
                noisy &= COMMENTS
            if noisy and not (noisy == {"header"} and (inside_article or OF_TEXT.intersection(words))):
                said = max(said, COMMENT if COMMENTS & noisy else NAME)
    return said


def parse(page: str) -> Node:
    """The tree of a page; strings and nodes in order in items."""
    root = Node("#root", None, False)
    at, here, n = 0, root, len(page)
    articles = 0
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            here.items.append(page[at:])
            break
        if m.start() > at:
            here.items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            up = here
            while up is not None and up.tag != tag:
                if up.tag in BLOCK and tag not in BLOCK:  # an inline end tag does not end blocks
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                while here is not up.parent:
                    articles -= here.tag in ("article", "main")
                    here = here.parent
            continue
        if tag in CLOSES:
            ends, walls = CLOSES[tag]
            up, found = here, None
            while up.parent is not None and up.tag not in walls:
                if up.tag in ends:
                    found = up
                elif up.tag in BLOCK and tag not in ("tr", "tbody", "thead", "tfoot"):
                    break
                up = up.parent
            if found is not None:
                here = found.parent
        drop = tag in DROP
        node = Node(tag, here, drop, 0 if drop else _named(tag, m[3], articles > 0))
        here.items.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            stop = end.start() if end else n
            node.items.append(page[at:stop])
            close = page.find(">", stop)
            at = close + 1 if end and close >= 0 else n
            continue
        here = node
        articles += tag in ("article", "main")
    return root


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of all nodes with text, children before parents."""
    order, stack, own = [], [(root, False)], {}
    while stack:
        node, link = stack.pop()
        order.append((node, link))
        stack.extend((x, link or x.tag == "a") for x in node.nodes())
        size = sum(len(x) - x.count(" ") - x.count("\n") for x in node.items if isinstance(x, str))
        own[id(node)] = size
        node.chars, node.link_chars = size, size if link else 0
    order.reverse()
    for node, link in order:
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + link
    body = root.link_chars / max(root.chars, 1)
    for node, link in order:
        if node.chars:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, body)
            if size := own[id(node)]:
                node.density_sum += density(size, 0, size if link else 0, 0, body)
        if node.parent is not None:
            node.parent.density_sum += node.density
    return [node for node, _ in order if node.chars]


def density(chars: int, tags: int, link_chars: int, link_tags: int, body: float) -> float:
    """The composite text density; body: the body's share of characters in links."""
    t, lc, lt = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars / max(chars - link_chars, 1) * lc + body * chars + math.e)
    return chars / t * math.log(max(chars / lc * t / lt, 1.0)) / math.log(base)


def _path(node: Node) -> list[Node]:
    out = [node]
    while (node := node.parent) is not None:
        out.append(node)
    return out


def _core(nodes: list[Node]) -> Node:
    """The node of the largest density sum: outside all named parts if it is worth it there."""
    apart: dict[int, int] = {}  # the strongest name on the path
    within: dict[int, bool] = {}  # whether an article or main is on it
    for n in reversed(nodes):  # parents come before children
        up = id(n.parent)
        apart[id(n)] = max(n.named, apart.get(up, 0))
        within[id(n)] = n.tag in ("article", "main") or within.get(up, False)
    holds = set()  # nodes with a named part in them
    for n in nodes:
        if n.named or id(n) in holds:
            holds.add(id(n.parent))
    article = [n for n in nodes if not apart[id(n)] and within[id(n)]]
    clean = article or [n for n in nodes if not apart[id(n)] and id(n) not in holds]
    rival = max((n for n in nodes if n.named and n.named != COMMENT and not apart.get(id(n.parent), 0)), key=lambda n: n.chars - n.link_chars, default=None)
    ids = {id(n) for n in clean}
    if not article and rival is not None and sum(n.chars for n in clean if id(n.parent) not in ids) < REST * (rival.chars - rival.link_chars):
        inside = {id(rival)}
        for n in reversed(nodes):
            if id(n.parent) in inside:
                inside.add(id(n))
        clean = [n for n in nodes if id(n) in inside]
    return max(clean or nodes, key=lambda n: n.density_sum)


def _mark(root: Node, nodes: list[Node], core: Node) -> list[Node]:
    """The outermost nodes whose subtrees are main text, in page order."""
    path = _path(core)
    threshold, holds = min(n.density for n in path), {id(n) for n in path}
    top: dict[int, Node] = {}
    for n in nodes:  # children come before parents; a part with a name is for itself
        top[id(n)] = max([n, *(top[id(x)] for x in n.nodes() if id(x) in top and (not x.named or id(x) in holds))], key=lambda x: x.density_sum)
    core.marked = True
    stack = [root]
    while stack:
        n = stack.pop()
        if id(n) not in top or n.marked or n.named and id(n) not in holds:
            continue
        # what holds the core is not taken whole: its own children are asked
        if n.density >= threshold and id(top[id(n)]) not in holds:
            top[id(n)].marked = True
        if not n.marked:
            stack.extend(n.nodes())
    found = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.marked:
            found.append(n)
        else:
            stack.extend(reversed(n.nodes()))
    return found


def _widen(found: list[Node], holds: set[int]) -> None:
    """Marks with the article or main around them, the blocks between them, and the headings above the first."""
    wide: list[Node] = []
    for n in found:
        up = next((x for x in reversed(_path(n)) if x.tag in ("article", "main") and not x.named), n)
        if not wide or wide[-1] is not up:
            wide.append(up)
    fits = lambda x: not isinstance(x, Node) or not x.drop and (not x.named or id(x) in holds) and x.link_chars < LINK_PART * max(x.chars, 1)
    if len(wide) > 1:
        paths = [list(reversed(_path(n))) for n in wide]
        depth = next(i for i, level in enumerate(zip(*paths, strict=False)) if len({id(x) for x in level}) > 1)
        common = paths[0][depth - 1]
        heads = {id(p[depth]) for p in paths}
        at = [i for i, x in enumerate(common.items) if id(x) in heads]
        for x in common.items[at[0] : at[-1] + 1]:
            if isinstance(x, Node) and id(x) not in heads and fits(x):
                x.marked = True
    for n in wide:
        n.marked = True
    last = wide[-1]
    if last.tag in RUNNING:
        for x in last.parent.items[next(i for i, x in enumerate(last.parent.items) if x is last) + 1 :]:
            if isinstance(x, Node) and x.chars:
                if x.tag not in RUNNING or not fits(x):
                    break
                x.marked = True
    first = wide[0]
    while first.parent is not None and first.tag not in ("article", "main"):
        before = first.parent.items[: next(i for i, x in enumerate(first.parent.items) if x is first)]
        last = next((i for i in range(len(before) - 1, -1, -1) if isinstance(before[i], Node) and (before[i].tag in HEADINGS and fits(before[i]) or not fits(before[i]) and before[i].chars)), None)
        if last is not None:
            if before[last].tag in HEADINGS:
                for x in before[last:]:
                    if isinstance(x, Node) and not x.drop:
                        x.marked = True
            break
        first = first.parent


def main_blocks(root: Node) -> list[str]:
    """Texts of the blocks of the main text, in page order."""
    nodes = _measure(root)
    if not nodes:
        return []
    core = _core(nodes)
    found = _mark(root, nodes, core)
    holds = {id(n) for n in _path(core)}
    _widen(found, holds)
    for n in nodes:
        if n.named and id(n) not in holds:
            n.drop = n.named != NAME or n.density < core.density
    out: list[str] = []
    stack = [root]
    while stack:
        n = stack.pop()
        if n.drop:
            continue
        if n.marked:
            out += block_texts(n)
        else:
            stack.extend(reversed(n.nodes()))
    return out


def block_texts(node: Node) -> list[str]:
    """Texts of the node's blocks in page order, references decoded, white space made one space."""
    out, parts = [], []

    def close():
        if parts and (text := " ".join(entities.unescape("".join(parts)).split())):
            out.append(text)
        parts.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        elif not x.drop:
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack.extend(reversed(x.items))
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(main_blocks(parse(page)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
