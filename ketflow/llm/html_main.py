"""Main-text extraction from HTML by tree scoring (operator 6).

A page becomes a small tree.  Scripts, buttons and the like hold no text to read and are
dropped.  Each paragraph earns points for its length and commas, discounted by its link
density, and passes them to its ancestors, halved at each level.  The container with the
most points, discounted by its own link density, is best; ``article`` and ``main`` get a
bonus.  It is widened to the ``article`` (or ``main``) that it lies in, as that is one
text; those of its siblings that read like text are kept too.  The blocks are joined in
page order.

Elements that by tag, role or class words are menus, forms, side matter or reader comments
are left out of the scoring and of the result.  As such words also stand on layout
wrappers ("no-sidebar", a form around the whole page), they are only a guess, which the
points of the paragraphs overrule: where next to no points are left without them, the
left-out elements with most points are wrappers and are taken back in (menus and footers
never are; others that hold no heading, ``article`` or ``main`` only if no text at all is
left).  If all articles are left out, the one with most points takes its ancestors back in.

One pass over the rows in Arrow batches, no shuffle; memory is one page's tree.  Parsing
and scoring take time in proportion to the page, whatever its nesting.

Edge cases: null, empty and textless pages give the empty text; broken markup is read
as browsers do for unclosed paragraphs, list items and cells; of equal scores the first in
the page is best; repeated rows are extracted alike; pages of any length are read whole;
an empty table gives no rows; extra columns pass through, but for one with the name of the
output, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from ketflow.llm.common import extended, map_arrow

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no text to read.
DROPPED = frozenset("head title script style noscript template button select textarea input iframe object embed svg canvas".split())
#: Elements that are seldom article text: left out unless the page has no other.
SIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies".split())
SIDE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notices sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs share sharing social related promo promotion promoted newsletter subscribe "
    "subscription popup modal overlay widget widgets pagination pager footer masthead topbar toolbar login signup skip outbrain taboola".split()
)
PARAGRAPH = frozenset("p pre td blockquote li dd".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the key closes an open element of the value, up to the nearest of the scope.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_CLOSED = frozenset(t for v in _CLOSES.values() for t in v)
_SCOPE = frozenset("ul ol dl table article section div main body html".split())
#: End tags of inline elements do not reach beyond these.
_BARRIER = frozenset(("article", "body", "table"))
_WORDS = re.compile(r"[a-z0-9]+")
#: Factor of the points of containers that say that they are the main part.
BONUS = {"article": 2.0, "main": 1.5}
#: Share of a page's points without which what is left out must hold the text.
LEAST_SHARE = 0.1
#: Share of the best container's points at which a neighbour is kept, and its link density at most.
SIBLING_SHARE, SIBLING_LINKS = 0.2, 0.33

WANTED, DROP, SIDE, COMMENT = range(4)


class Node:
    """An element; ``kind`` tells why it is left out, ``on`` whether it is in what was measured last.

    ``points`` are those that its paragraphs below pass on to it, ``total`` the plain sum of theirs.
    """

    __slots__ = ("tag", "parent", "children", "kind", "named", "depth", "on", "own", "commas", "blocks", "titled", "points", "total", "size", "linked", "open_p", "outer", "in_article", "in_comment", "barrier")

    def __init__(self, tag: str, parent: Node | None, kind: int = WANTED, named: str = "") -> None:
        self.tag, self.parent, self.kind, self.named = tag, parent, kind, named
        self.children: list[Node | str] = []
        self.own = self.commas = 0
        self.on = True
        # what start and end tags below ask of the open elements, so that they need not walk up
        if parent is None:
            self.depth = self.barrier = 0
            self.open_p, self.outer, self.in_article, self.in_comment = None, {}, False, False
            return
        self.depth = parent.depth + 1
        self.open_p: Node | None = self if tag == "p" else None if tag in BLOCK else parent.open_p
        self.in_article = tag == "article" or parent.in_article
        self.in_comment = kind == COMMENT or parent.in_comment
        self.barrier: int = self.depth if tag in _BARRIER else parent.barrier
        self.outer: dict[str, Node] = {} if tag in _SCOPE else parent.outer
        if tag in _CLOSED and tag not in self.outer:
            self.outer = {**self.outer, tag: self}


def _kind(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> int:
    if tag in DROPPED:
        return DROP
    if tag in ("html", "body"):
        return WANTED
    kind = SIDE if tag in SIDE_TAGS or tag == "header" and not inside_article else WANTED
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return DROP
        if name in ("class", "id") and value:
            words = set(_WORDS.findall(value.lower()))
            if words & COMMENT_WORDS:
                return COMMENT
            if words & SIDE_WORDS and tag not in ("main", "article"):
                kind = SIDE
        elif name == "role" and value in SIDE_ROLES and tag not in ("main", "article"):
            kind = SIDE
    return kind


class _Tree(HTMLParser):
    """Builds the tree; ``path`` are the open elements and ``places`` their depths by tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.nodes = [self.root]  # in page order: parents before children
        self.path = [self.root]
        self.places: dict[str, list[int]] = {}

    def _close(self, depth: int) -> None:
        """Close the element at a depth and all inside it."""
        while len(self.path) > max(depth, 1):
            self.places[self.path.pop().tag].pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in BLOCK and (p := self.path[-1].open_p) is not None:
            self._close(p.depth)
        if closes := _CLOSES.get(tag):
            outer = self.path[-1].outer
            if depths := [outer[t].depth for t in closes if t in outer]:
                self._close(min(depths))
        up = self.path[-1]
        node = Node(tag, up, _kind(tag, attrs, up.in_article), next((v or "" for k, v in attrs if k == "class"), ""))
        up.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.path.append(node)
            self.places.setdefault(tag, []).append(node.depth)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and self.path[-1].tag == tag:
            self._close(len(self.path) - 1)

    def handle_endtag(self, tag: str) -> None:
        depths = self.places.get(tag)
        if depths and (tag in BLOCK or depths[-1] >= self.path[-1].barrier):
            self._close(depths[-1])

    def handle_data(self, data: str) -> None:
        at = self.path[-1]
        at.children.append(data)
        at.own += len(data.strip())
        at.commas += data.count(",")


def _measure(nodes: list[Node], all_kinds: bool = False) -> None:
    """Text and link sizes and points of every node that is not left out (or, with ``all_kinds``, not dropped)."""
    for n in nodes:
        n.on = n.parent is None or n.parent.on and (n.kind == WANTED or all_kinds and n.kind != DROP)
        n.size, n.linked, n.points, n.total, n.blocks, n.titled = n.own, 0, 0.0, 0.0, False, n.tag in BONUS or n.tag == "h1"
    for n in reversed(nodes):
        if not n.on:
            continue
        if n.tag == "a":
            n.linked = n.size
        passed = n.points / 2
        if n.size and (n.tag in PARAGRAPH or n.own >= 25 and not n.blocks and n.tag in BLOCK):
            mine = (1 + n.commas + min(n.size / 100, 3)) * (1 - n.linked / n.size)
            passed += mine
            n.total += mine
        if (up := n.parent) is not None:
            up.size += n.size
            up.linked += n.linked
            up.points += passed
            up.total += n.total
            up.blocks = up.blocks or n.size > 0 and n.tag in BLOCK
            up.titled = up.titled or n.titled


def _take_back(nodes: list[Node]) -> None:
    """Take wrappers back in: elements left out for their name, without which next to no points are left."""
    root = nodes[0]
    _measure(nodes, True)
    everything, inside = root.total, [(n, n.total, n.titled) for n in nodes if n.on and n.total]
    _measure(nodes)
    have, free = root.total, {id(root)}

    def take(node: Node | None) -> None:
        while node is not None and id(node) not in free:
            node.kind = WANTED
            free.add(id(node))
            node = node.parent

    if not any(n.on and n.tag in BONUS and n.total for n in nodes):
        if articles := [(total, n) for n, total, _ in inside if n.tag in BONUS and not n.in_comment]:
            total, one = max(articles, key=lambda x: x[0])
            take(one)
            have += total
    guessed = [(n, t, h) for n, t, h in inside if n.kind == SIDE and n.tag not in ("nav", "footer", "menu") or n.kind == COMMENT and h]
    for n, total, titled in sorted(guessed, key=lambda x: (x[0].kind, -x[1], x[0].depth)):
        if have > LEAST_SHARE * everything:
            break
        if titled or not have:
            take(n)
            have += total
    if len(free) > 1:
        _measure(nodes)


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _keep(nodes: list[Node]) -> list[Node]:
    """The best container and the neighbours that read like text, in page order."""
    best, best_value = nodes[0], -1.0
    for node in nodes:
        if node.on and node.size and (value := node.points * (1 - _density(node)) * BONUS.get(node.tag, 1.0)) > best_value:
            best, best_value = node, value
    points = best.points * (1 - _density(best))
    for wanted in BONUS:
        up: Node | None = best
        while up is not None and up.tag != wanted:
            up = up.parent
        if up is not None:
            best = up
            break
    if best.parent is None:
        return [best]
    out = []
    for c in best.parent.children:
        if c is best:
            out.append(c)
        elif isinstance(c, Node) and c.kind == WANTED and c.size and _density(c) < SIBLING_LINKS:
            text_like = c.tag in PARAGRAPH or c.tag in HEADING or c.total and (c.tag, c.named) == (best.tag, best.named)
            if c.points * (1 - _density(c)) >= max(1.0, SIBLING_SHARE * points) or text_like and best.tag not in BONUS:
                out.append(c)
    return out


def _blocks(node: Node, out: list[str]) -> None:
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            parts.append(n)
        elif n.kind != WANTED:
            continue
        else:
            if n.tag == "br":
                parts.append(" ")
            if n.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(n.children)
    flush()


def extract(html: str | None) -> str:
    """Main text of one page, a line a block."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _take_back(tree.nodes)
    out: list[str] = []
    for n in _keep(tree.nodes):
        _blocks(n, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` plus the extracted text."""
    pages, schema = extended(pages, **{out: "string"})
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([extract(h) for h in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[f"c{i}" for i in range(b.num_columns + 1)])

    return map_arrow(pages, run, schema)


def oracle() -> str:
    """DuckDB SQL for pages of one known template (an ``article`` of h1 and p blocks, as in the tables here).

    Not a general extractor: regular expressions cannot score a tree.
    """
    blocks = "list_filter(list_transform(regexp_split_to_array(regexp_replace(body, '</?b>', '', 'g'), '</?(p|h1)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '')"
    return f"""
    WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer|$)', 1) AS body FROM pages),
    b AS (SELECT page_id, url, array_to_string({blocks}, chr(10)) AS raw FROM a),
    t AS (SELECT page_id, url, coalesce(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '') AS text FROM b)
    SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""
