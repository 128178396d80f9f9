"""Main text of web pages by composite text density.

A page becomes a tree, without what is never text (scripts, styles, controls, hidden elements).  Every
node gets its characters per tag, adjusted for how much of it is links; the sum of the densities of
its children tells where text gathers.  The node with the largest sum is the core of the article, and the
least density on its path to the body (or to the ``article`` or ``main`` element around it) is the
threshold that other subtrees have to reach to belong to it.

Names (tags, roles, classes, ids) enter in two places only.  The text of elements that they mark as menus, notices,
adverts or comments counts as link text in the densities.  And below the threshold they decide what a
density cannot: headings and other parts of the same ``article`` or ``main`` stay, marked parts and lists of
links go.
"""

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import free_name


VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: an open paragraph ends before these
ENDS_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: an open element of the value's kinds ends before the key, up to the nearest list or table
ENDS_ITEM = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPE = set("ul ol dl table select menu body".split())
#: never text
NEVER = set(
    "head script style noscript template button select option textarea input iframe object embed svg "
    "canvas audio video title".split()
)
#: their text counts as link text, unless they hold the page's only heading, article or main element
WRAPPERS = set("nav footer aside form dialog menu header".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: what may be a menu if it holds nothing but links
LISTS = set("ul ol dl table div section nav menu".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "sidebar sidebars comment comments commentlist disqus respond reply replies discussion "
    "cookie cookies consent gdpr notice notices notification popup modal overlay alert "
    "newsletter subscribe signup login share sharing social breadcrumb breadcrumbs menu menus navbar nav navigation "
    "footer header masthead related recommended widget widgets toolbar pagination pager".split()
)
#: names of what readers wrote; other names inside an article need links or controls to agree
DISCUSSION = set("comments commentlist disqus replies".split())
ARTICLE = ("article", "main")
CONTROLS = set("form input button select textarea iframe".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+").findall


class Node:
    __slots__ = ("tag", "parent", "content", "hinted", "named", "gone", "marked", "chars", "tags", "link_chars", "link_tags", "own", "density", "total")

    def __init__(self, tag, parent, hinted=False, named=False, gone=False):
        self.tag, self.parent, self.content, self.hinted, self.named, self.gone = tag, parent, [], hinted, named, gone
        self.marked = False
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.density = self.total = 0.0


def _hidden(attributes: dict) -> bool:
    style = (attributes.get("style") or "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style


def _hinted(attributes: dict) -> tuple[bool, bool, bool]:
    """Whether the element is marked as no part of an article, whether only a name says so, and whether it is hidden."""
    if _hidden(attributes):
        return True, False, True
    if attributes.get("role") in ROLES:
        return True, False, False
    named = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
    words = {w.lower() for w in _WORDS(named)} & HINTS if named != " " else set()
    return bool(words), bool(words) and not words & DISCUSSION, False


class Tree(HTMLParser):
    """Elements and text in page order; end tags may be missing, as in most pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", None)
        self.nodes = [self.root]

    def _close(self, kinds, scope):
        node = self.at
        while node.parent is not None and node.tag not in scope:
            if node.tag in kinds:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close(("p",), SCOPE | {"td", "th", "li", "div", "article", "section", "main", "button", "blockquote"})
        if tag in ENDS_ITEM:
            for kind in ENDS_ITEM[tag]:
                self._close((kind,), SCOPE)
        node = Node(tag, self.at, *(_hinted(dict(attrs)) if attrs else ()))
        self.at.content.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.content.append(data)


def parse(html: str) -> list[Node]:
    """Nodes in page order, parents before children."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.nodes


def _needed(nodes: list[Node]) -> set[int]:
    """Wrappers around what the page has nowhere else: its heading, article or main element, or most of its text if a form."""
    if not any(n.tag in WRAPPERS for n in nodes):
        return set()
    wrapped, outside, holds, text = set(), set(), {}, {}
    for node in nodes:
        if node.parent is not None and (node.parent.tag in WRAPPERS or id(node.parent) in wrapped):
            wrapped.add(id(node))
        elif node.tag in ("h1", "main", "article") and not node.hinted:
            outside.add(node.tag)
    for node in reversed(nodes):
        held = holds.setdefault(id(node), set())
        chars = text.get(id(node), 0) + sum(len("".join(c.split())) for c in node.content if isinstance(c, str))
        text[id(node)] = chars
        if node.tag in ("h1", "main", "article") and not node.hinted:
            held.add(node.tag)
        hidden = node.hinted and not node.named or node.tag in NEVER
        if node.parent is not None and not hidden:
            holds.setdefault(id(node.parent), set()).update(held)
            # menus and other sections beside the text are not text of a form
            text[id(node.parent)] = text.get(id(node.parent), 0) + (chars if node.tag == "form" or node.tag not in WRAPPERS else 0)
    most = {id(n) for n in nodes if n.tag == "form" and 2 * text[id(n)] > text[id(nodes[0])] and not outside & set(ARTICLE)}
    return most | {id(n) for n in nodes if n.tag in WRAPPERS and holds[id(n)] - outside}


def _agrees(nodes: list[Node], needed: set[int]) -> set[int]:
    """Named elements that also look like no text: half of their characters are links, or they hold controls and less than half of the page's text."""
    if not any(n.named for n in nodes):
        return set()
    chars, links, controls = {}, {}, set()
    for node in reversed(nodes):
        k = id(node)
        chars[k] = chars.get(k, 0) + sum(len("".join(c.split())) for c in node.content if isinstance(c, str))
        links[k] = chars[k] if node.tag == "a" else links.get(k, 0)
        if node.tag in CONTROLS:
            controls.add(k)
        if node.parent is not None:
            above = id(node.parent)
            if node.tag not in NEVER and node.tag not in WRAPPERS or k in needed:
                chars[above], links[above] = chars.get(above, 0) + chars[k], links.get(above, 0) + links[k]
            if k in controls:
                controls.add(above)
    return {id(n) for n in nodes if n.named and (2 * links[id(n)] >= chars[id(n)] or id(n) in controls and 2 * chars[id(n)] < chars[id(nodes[0])])}


def prune(nodes: list[Node]) -> list[Node]:
    """Cut what is never text, and return the other nodes, with ``marked`` on those that names call no article.

    A name alone marks no element that holds the page's heading or a whole article, since
    such names also stand on the frame around everything; inside an article or main element it marks only
    what links or controls show to be no text.  A form or other section around the page's heading
    or article is not marked, but the labels of its controls are.
    """
    holds = set()
    for node in reversed(nodes):
        if node.tag in ("h1", "main", "body") or (node.tag == "article" and not node.hinted) or id(node) in holds:
            holds.add(id(node))
            if node.parent is not None:
                holds.add(id(node.parent))
    needed = _needed(nodes)
    agrees = _agrees(nodes, needed)
    inside, unwrapped = set(), set()  # nodes within an article or main element, and within a form that stays
    for node in nodes:
        above = node.parent
        if above is None:
            continue
        if above.tag in ARTICLE or id(above) in inside:
            inside.add(id(node))
        if id(above) in unwrapped or (above.tag == "form" and id(above) in needed):
            unwrapped.add(id(node))
        node.gone = node.gone or above.gone or node.tag in NEVER
        wrapper = node.tag in WRAPPERS and not (node.tag == "header" and id(node) in inside)
        wrapper = wrapper or (node.tag == "label" and id(node) in unwrapped)
        named = node.hinted and id(node) not in holds
        if named and node.named and id(node) in inside:
            named = id(node) in agrees
        node.marked = above.marked or ((wrapper or named) and id(node) not in needed)
    return [n for n in nodes if not n.gone]


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, scaled down by the share of links, and further in pages full of links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = math.log(chars * links / max(chars - link_chars, 1) + body_share * chars + math.e)
    ratio = max(chars / links * tags / link_tags, 1.0)
    return chars / tags * math.log(ratio) / math.log(base)


def _body_share(nodes: list[Node]) -> float:
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    return max(body.link_chars, 1) / max(body.chars, 1)


def measure(nodes: list[Node]) -> None:
    """Characters, tags and links below every node, its composite density, and the sum over its children.

    The text of marked nodes counts as link text.
    """
    for node in nodes:
        node.own = sum(len("".join(c.split())) for c in node.content if isinstance(c, str))
    for node in reversed(nodes):
        node.chars += node.own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.marked:
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        above = node.parent
        if above is not None:
            above.chars += node.chars
            above.tags += node.tags + 1
            above.link_chars += node.link_chars
            above.link_tags += node.link_tags
    body_share = _body_share(nodes)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, body_share)
    for node in nodes:
        node.total += 0 if node.tag == "a" or node.marked else node.own
        if node.parent is not None:
            node.parent.total += node.density


def select(nodes: list[Node]) -> tuple[list, set[int]]:
    """Subtrees and loose texts of the article in page order, and the ids of nodes below them that do not belong to it."""
    best = max(nodes, key=lambda n: n.total)  # the first of equal ones is the outermost
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    around = next((i for i, n in enumerate(path) if n.tag in ARTICLE), None)
    to_body = next((i for i, n in enumerate(path) if n.tag == "body"), len(path) - 1)
    threshold = min(n.density for n in path[: (to_body if around is None else around) + 1])
    body_share = _body_share(nodes)

    def low(node):
        return node.density < threshold or not node.density

    def menu(node):
        return node.marked or (node.tag in LISTS and node.link_tags > 1 and node.link_chars >= node.chars)

    before, after = [], []  # of the subtrees below them on the path
    for i in range(len(path) - 1, 0, -1):
        same, found, below = around is not None and i <= around, before, []
        for item in path[i].content:
            if item is path[i - 1]:
                found = below
            elif isinstance(item, str):
                chars = len("".join(item.split()))
                if not path[i].marked and (same or _density(chars, 0, 0, 0, body_share) >= threshold):
                    found.append(item)
            elif item.chars and item.tag != "a" or same:
                if not low(item) or not menu(item) and (same or item.tag in HEADINGS):
                    found.append(item)
        before.append("\n")
        after = ["\n", *below, *after]
    chosen = [*before, best, *after]
    dropped, stack = set(), [n for n in chosen if isinstance(n, Node)]
    while stack:
        for node in stack.pop().content:
            if isinstance(node, Node):
                if low(node) and menu(node):
                    dropped.add(id(node))
                else:
                    stack.append(node)
    return chosen, dropped


def text_of(roots: list, dropped: set[int] = frozenset()) -> str:
    """Text below the roots: white space is one space, and so is a block's edge."""
    parts, stack = [], list(reversed(roots))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.gone and id(item) not in dropped:
            edge = [] if item.tag in INLINE else ["\n"]
            stack.extend([*edge, *reversed(item.content), *edge])
    return " ".join("".join(parts).split())


def main_text(html: str | None) -> str:
    """The article of one page; empty for null, empty or textless pages."""
    if not html:
        return ""
    nodes = prune(parse(html))
    measure(nodes)
    return text_of(*select(nodes)) if nodes[0].chars else ""


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in ``text_col`` and its code points in ``n_chars``.

    Null and empty pages give an empty text.  All rows and other columns stay, the page itself is left
    out, and columns named like the new ones are replaced.  Whole pages are read; nesting of any depth is followed without
    recursion.
    """
    from pyspark.sql.functions import arrow_udf

    def run(html: pa.Array) -> pa.Array:
        return pa.array([main_text(h) for h in html.to_pylist()], pa.string())

    name = free_name(pages, "found")
    found = pages.withColumn(name, arrow_udf(run, "string")(F.col(html_col).cast("string")))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    return found.select(*kept, F.col(name).alias(text_col), F.char_length(name).cast("long").alias("n_chars"))
