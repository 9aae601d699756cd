"""Main text of web pages by scoring the tree.

Every paragraph passes points for its length and its commas to its ancestors, fewer the
further up; a container's points are discounted by the share of its text that is links.
An article or main around the best container stands for it. Beside it all that holds text is
kept but lists of links: inside the main around it, or in the whole page if there is none.
What tags or names mark as menus, adverts, forms or comments is left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import col
from plumbline.llm.words import blocks

# Elements by their part in a page (HTML living standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset(
    "script style noscript template head title nav header footer aside button select "
    "textarea input iframe object embed svg math canvas menu dialog noembed noframes xmp".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl dt table th figure figcaption caption address".split())
CONTAINERS = frozenset("article main section div body td".split())
# A new paragraph or block ends an open paragraph.
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

UNLIKELY = re.compile(
    r"(^|[\s_-])(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|disqus|replies|"
    r"reply|respond|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"signup|login|share|sharing|social|sidebar|side-?bar|rail|widget|related|recommend\w*|"
    r"menu|nav\w*|breadcrumbs?|pagination|pager|toolbar|masthead|footer|header|skip|"
    r"copyright|legal|disclaimer|search)($|[\s_-])",
    re.IGNORECASE,
)
# An article's own names often tell what stands around it.
UNLIKELY_ARTICLE = re.compile(
    r"(^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|comments?|replies|reply|related|teaser)($|[\s_-])",
    re.IGNORECASE,
)
# Inside an article these mark parts of it: notes, and what stands around headings.
OWN_PARTS = re.compile(r"(?<![^\s_-])(header|legal|disclaimer|notice|alert)(?![^\s_-])", re.IGNORECASE)
# Names of what a container has, or how it behaves, not of what it is.
_HAS = re.compile(r"(?<![^\s_-])(has|with|without|no)[_-]\S*", re.IGNORECASE)
_STICKY = re.compile(r"(?<=\S\s)sticky[_-]\S*|(?<!\S)sticky[_-]\S*(?=\s+\S)", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
UNLIKELY_ROLES = frozenset(
    "navigation banner complementary contentinfo search alert alertdialog dialog menu menubar".split()
)

# Containers above a paragraph that get points from it.
LEVELS = 8
# What holds a larger share of links is no text by itself.
MAX_LINKS = 0.25

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_ATTRIBUTE = re.compile(
    r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
)


class Node:
    __slots__ = (
        *("tag", "parent", "children", "names", "dropped", "doubtful", "in_article", "container"),
        # Characters right inside, all characters below, those in links, commas, points.
        *("own", "chars", "links", "commas", "score", "holds"),
    )

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.children = tag, parent, []
        self.own = self.chars = self.links = self.commas = 0
        self.score = 0.0
        self.holds = False  # paragraphs, lists or tables with text
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        # The nearest container above, or the root.
        self.container = parent
        if parent is not None and parent.parent is not None and parent.tag not in CONTAINERS:
            self.container = parent.container
        self.names = ""
        self.dropped = tag in SKIPPED
        # Dropped as well, unless the text of the page is in there.
        self.doubtful = tag == "form"
        if attributes and not self.dropped and tag not in ("html", "body"):
            self.names = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
            self.dropped = (
                "hidden" in attributes
                or attributes.get("aria-hidden") == "true"
                or attributes.get("role", "").lower() in UNLIKELY_ROLES
                or _NOT_SHOWN.search(attributes.get("style", "")) is not None
            )
            self.doubtful |= self._unlikely()

    def _unlikely(self) -> bool:
        """Do the names say that the element is no part of the text?"""
        if not self.names or self.tag == "main":
            return False
        names = _STICKY.sub(" ", _HAS.sub(" ", self.names))
        if self.tag == "article" or self.tag in HEADINGS:
            return UNLIKELY_ARTICLE.search(names) is not None
        if UNLIKELY.search(names) is None:
            return False
        return UNLIKELY.search(OWN_PARTS.sub(" ", names)) is not None or not self.in_article


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and misplaced tags end where HTML lets them."""
    root = node = Node("html", None, {})
    at, end = 0, len(page)
    # How many elements of a name are open, so that a stray end tag needs no search.
    opened: Counter = Counter()

    def left(node: Node, until: Node) -> Node:
        while node is not until:
            opened[node.tag] -= 1
            node = node.parent
        return node

    while at < end:
        found = _TOKEN.search(page, at)
        cut = found.start() if found else end
        if cut > at:
            node.children.append(entities.unescape(page[at:cut]))
        if not found:
            break
        at = found.end()
        tag = found["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if found["close"]:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = left(node, up.parent)
            continue
        if tag == "html":
            continue
        node = left(node, _closed(node, tag))
        rest = found["rest"]
        attributes = (
            {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(rest)}
            if rest
            else {}
        )
        child = Node(tag, node, attributes)
        node.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)
            until = close.search(page, at)
            if until:
                child.children.append(page[at : until.start()])
                at = until.end()
            else:
                child.children.append(page[at:])
                at = end
        elif tag not in VOID and not rest.endswith("/"):
            node = child
            opened[tag] += 1
    return root


def _closed(node: Node, tag: str) -> Node:
    """Where a new element goes after the open ones it ends."""
    ends = {"p"} if tag in ENDS_PARAGRAPH else ENDS_ITSELF.get(tag)
    if not ends:
        return node
    up = node
    while up.parent is not None:
        if up.tag in ends:
            return up.parent
        # Only inline elements may be open in between.
        if up.tag not in INLINE:
            return node
        up = up.parent
    return node


def _pieces(node: Node) -> Iterator[str]:
    """Text below a node in page order, with a line feed at every edge of a block."""
    stack = [iter(node.children)]
    tags = [node.tag]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if tags.pop() not in INLINE:
                yield "\n"
        elif isinstance(child, str):
            yield child
        elif not child.dropped:
            if child.tag not in INLINE:
                yield "\n"
            stack.append(iter(child.children))
            tags.append(child.tag)


def text_of(node: Node) -> str:
    return " ".join("".join(_pieces(node)).split())


def _foreign(node: Node) -> bool:
    """Does the element call itself comments, adverts or the like?"""
    return node.doubtful and UNLIKELY_ARTICLE.search(_HAS.sub(" ", node.names)) is not None


def _drop_doubtful(root: Node) -> None:
    """Drops the doubtful elements, but not those that the text of the page is in: its
    article or main (the one with most points), or most of the points of all paragraphs
    with no article or main elsewhere. Foreign elements stay only if there is no other
    article and not as much text elsewhere, or no other text at all."""
    nodes, ups = [root], [-1]
    own, commas = [], []
    for k, node in enumerate(nodes):  # grows as it goes
        texts = [x for x in node.children if isinstance(x, str)]
        own.append(sum(len(w) for x in texts for w in x.split()))
        commas.append(sum(x.count(",") for x in texts))
        for child in node.children:
            if not isinstance(child, str) and not child.dropped:
                nodes.append(child)
                ups.append(k)
    if not any(x.doubtful for x in nodes):
        return
    foreign = [_foreign(x) for x in nodes]
    chars, links = list(own), [0] * len(nodes)
    # Points below, those of them in foreign elements, articles and mains below.
    points, odd, stands = [0.0] * len(nodes), [0.0] * len(nodes), [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        node, up = nodes[k], ups[k]
        if node.tag == "a":
            links[k] = chars[k]
        if chars[k]:
            plain = 1 - links[k] / chars[k]
            if node.tag in PARAGRAPHS:
                points[k] += (1 + commas[k] + min(chars[k] / 100, 3)) * plain
            elif node.tag in CONTAINERS and own[k]:
                points[k] += (1 + min(own[k] / 100, 3)) * plain
        if foreign[k]:
            odd[k] = points[k]
        if up >= 0:
            chars[up] += chars[k]
            links[up] += links[k]
            commas[up] += commas[k]
            points[up] += points[k]
            odd[up] += odd[k]
            stands[up] += stands[k] + (_standing(node) and chars[k] > 0)
    within, around = [False] * len(nodes), [0] * len(nodes)
    best: dict[str, tuple] = {}
    for k, node in enumerate(nodes):
        if k:
            within[k] = within[ups[k]] or foreign[k]
            around[k] = around[ups[k]] + _standing(nodes[ups[k]])
        if _standing(node) and chars[k] and not node.in_article:
            best[node.tag] = max(best.get(node.tag, (False, -1.0, 0)), (not within[k], points[k], -k))
    holds = set()
    for _, _, k in best.values():
        k = -k
        while k >= 0:
            holds.add(k)
            k = ups[k]
    for k, node in enumerate(nodes):
        if not node.doubtful:
            continue
        alone = stands[0] - stands[k] - around[k] <= 0
        if foreign[k]:
            rest = points[0] - points[k]
            keep = points[k] > 0 and (rest < 1e-9 or (k in holds and alone and points[k] > rest))
        else:
            mine = points[k] - odd[k]
            keep = k in holds or (alone and mine > points[0] - odd[0] - mine)
        node.dropped = not keep


def _standing(node: Node) -> bool:
    return node.tag in ("article", "main") and not node.doubtful


def _scored(root: Node) -> list[Node]:
    """The containers that paragraphs passed points to, links discounted."""
    nodes = [root]
    for node in nodes:  # grows as it goes
        for child in node.children:
            if isinstance(child, str):
                node.own += sum(map(len, child.split()))
                node.commas += child.count(",")
            elif not child.dropped:
                nodes.append(child)
        node.chars = node.own
    for node in reversed(nodes):
        if node.tag == "a":
            node.links = node.chars
        node.holds |= node.chars > 0 and (node.tag in PARAGRAPHS or node.tag in LISTS)
        if node.parent is not None:
            node.parent.holds |= node.holds
            node.parent.chars += node.chars
            node.parent.links += node.links
            node.parent.commas += node.commas
    scored: dict[int, Node] = {}
    for node in nodes:
        if node.tag in PARAGRAPHS and node.chars:
            points = 1 + node.commas + min(node.chars / 100, 3)
            up = node.parent
        elif node.tag in CONTAINERS and node.own:
            points = 1 + min(node.own / 100, 3)  # text right inside a container
            up = node
        else:
            continue
        if up.tag not in CONTAINERS and up.parent is not None:
            up = up.container
        for level in range(LEVELS):
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[id(up)] = up
            up = up.container
            if up is None:
                break
    for node in scored.values():
        node.score *= 1 - _link_density(node)
    return list(scored.values())


def _link_density(node: Node) -> float:
    return node.links / node.chars if node.chars else 1.0


def _is_prose(text: str, density: float) -> bool:
    """Is it long and mostly not links, or a sentence without links?"""
    return (len(text) > 80 and density < MAX_LINKS) or (
        bool(text) and density == 0 and re.search(r"[.!?…]($|\s)", text) is not None
    )


def _run_text(run: list, linked: bool) -> str:
    """Text of neighbouring strings and inline elements, if it is not mostly links; in a
    part that is ``linked``, if it is prose."""
    held = Node("span", None, {})
    held.children = run
    text = text_of(held)
    chars = sum(len(w) for w in text.split())
    links = sum(x.links for x in run if isinstance(x, Node))
    density = links / chars if chars else 1.0
    return text if density < MAX_LINKS and (not linked or _is_prose(text, density)) else ""


def _around(root: Node, top: Node) -> list[str]:
    """Texts of a container and of all other parts of the page that hold text and are not
    mostly links, in page order. Of parts that are mostly links only the prose is taken."""
    path, up = set(), top
    while up is not None:
        path.add(id(up))
        up = up.parent
    texts = []
    stack: list[tuple[Node | list, bool]] = [(root, False)]
    while stack:
        part, linked = stack.pop()
        if isinstance(part, list):
            texts.append(_run_text(part, linked))
            continue
        if part is top and part is not root:
            texts.append(text_of(part))
            continue
        if id(part) not in path:
            density = _link_density(part)
            if part.tag == "p" and not linked:
                texts.append(text_of(part))  # a reference, not an entry of a list
                continue
            if part.holds and density < MAX_LINKS:
                text = text_of(part)
                if not linked or _is_prose(text, density):
                    texts.append(text)
                    continue
            linked |= density >= MAX_LINKS
        parts: list[Node | list] = []
        run: list = []
        for child in part.children:
            if isinstance(child, Node) and child.dropped:
                continue
            if isinstance(child, str) or (
                (child.tag in INLINE or child.tag in VOID) and id(child) not in path and not child.holds
            ):
                run.append(child)
                continue
            if run:
                parts.append(run)
                run = []
            parts.append(child)
        if run:
            parts.append(run)
        stack.extend((x, linked) for x in reversed(parts))
    return texts


def main_text(page: str | None) -> str:
    """The text of the best container and of what stands beside it, blocks in page order."""
    root = parse(page or "")
    _drop_doubtful(root)
    scored = _scored(root)
    if not scored:
        return text_of(root)
    for tags in (("article",), ("main",), CONTAINERS | {"html"}):
        if like := [n for n in scored if n.tag in tags and not n.in_article]:
            break
    top = up = max(like or scored, key=lambda n: n.score)
    while up is not None and up.tag != "main":
        up = up.parent
    return " ".join(x for x in _around(up or root, top) if x)


def extracted(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """(id, url, text, n_chars) of each row: its main text and how many code points it has.

    NULL and empty pages, and pages without text, give an empty text. Pages of any length and
    depth are read whole, in time that grows with their length. NULL ids and urls stay
    NULL, repeated rows give equal rows, no rows none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data in blocks(batch.column(2)):
                texts = [main_text(x.decode("utf-8", "replace")) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        batch.column(1).slice(first, last - first),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        col(id_column).cast("bigint").alias("id"),
        col(url_column).cast("string").alias("url"),
        col(html_column).cast("string").alias("html"),
    )
    return rows.mapInArrow(
        run, "id bigint, url string, text string, n_chars bigint"
    ).withColumnsRenamed({"id": id_column, "url": url_column})
