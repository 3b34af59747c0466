"""Main text of web pages by scoring the tree of elements.

Paragraphs pass points for their length and commas to their ancestors, less the farther
up, and a container's points are discounted by the share of its text inside links. The
best container is kept together with those of its siblings that score well or read like
paragraphs. Boilerplate elements (by tag, role or class words) are left out before,
unless one that only its class, id or being a form speaks against holds the main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: what the elements of HTML mean
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
DROPPED = frozenset(
    "aside button canvas dialog fieldset footer head header iframe input label menu "
    "nav noscript object script select style svg template textarea title".split()
)
SUSPECT = frozenset({"form"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("dl ol ul".split())
PARAGRAPHS = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
BLOCKS = PARAGRAPHS | frozenset(
    "address article body center details div dl figure hr html main ol section summary "
    "table tbody tfoot thead tr ul".split()
)
# an opening tag of these ends an open element of the same set inside the nearest block
CLOSED_BY_NEXT = (
    frozenset({"li"}), frozenset({"dt", "dd"}), frozenset({"tr"}), frozenset({"td", "th"}),
    frozenset({"option"}),
)
BOILERPLATE_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer header masthead menu modal nav navbar navigation "
    "newsletter notice notification pager pagination popup promo promoted promotion related "
    "share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "widget".split()
)
# a header is boilerplate as the last word of a name only where it is that of the site
HEADER_OWNERS = frozenset("app global site top".split())
LEAST_SHARE = 2.0**-24  # of a paragraph's points, for an ancestor to be given any
MAIN_TAGS = frozenset({"article", "main"})

_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANKS = re.compile(r"\s+")
_UNSEEN = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)")
SIBLING_SHARE = 0.2  # of the best score, for a sibling to be kept
SIBLING_CHARS = 80  # of a paragraph beside an article or main element
SIBLING_LINKS = 0.25  # and its share of text inside links


class Node:
    __slots__ = (
        "tag", "parent", "children", "points", "own", "held", "chars", "linked", "dropped",
        "suspect", "named", "inside", "inside",
    )

    def __init__(
        self,
        tag: str,
        parent: Node | None,
        dropped: bool = False,
        suspect: bool = False,
        named: bool = False,
    ):
        self.tag, self.parent, self.dropped, self.named = tag, parent, dropped, named
        # whether it is, or is below, a declared main element
        self.inside = named or (parent is not None and parent.inside)
        self.suspect = suspect  # boilerplate unless it holds the main text
        self.own, self.held = 0.0, 0.0  # points as a paragraph, and of all paragraphs below
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0
        if parent is not None:
            parent.children.append(self)


def _boilerplate(attrs: list[tuple[str, str | None]]) -> bool:
    values = {k: v or "" for k, v in attrs}
    role = values.get("role", "").lower()
    return (
        (role in BOILERPLATE_ROLES and role != "form")
        or "hidden" in values
        or values.get("aria-hidden", "").lower() == "true"
        or bool(_UNSEEN.search(values.get("style", "").lower()))
    )


def _named_boilerplate(name: str) -> bool:
    """Whether the first or the last word of a class or id is a boilerplate word."""
    words = _WORD.findall(_CAMEL.sub(" ", name).lower())
    if not words:
        return False
    last = words[-1] in BOILERPLATE_WORDS and (
        words[-1] != "header" or words[0] in HEADER_OWNERS
    )
    return last or words[0] in BOILERPLATE_WORDS


def _suspect(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether a class or the id has a boilerplate name, or the role is form."""
    values = {k: v or "" for k, v in attrs}
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    return values.get("role", "").lower() == "form" or any(map(_named_boilerplate, names))


class _Tree(HTMLParser):
    """The elements of a page; unclosed and misplaced tags are put right as browsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at = self.root
        self.open: Counter[str] = Counter()  # tags of the open elements

    def _end(self, node: Node) -> None:
        """End the open elements up to ``node``, which is open."""
        while True:
            self.open[self.at.tag] -= 1
            self.at, last = self.at.parent, self.at
            if last is node:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            # a page has one of each, whatever it repeats; their classes mean nothing
            if tag == "body":
                self._close({"head"})
            return
        if tag in VOID:
            if tag in ("br", "hr"):
                self.at.children.append(" ")
                if tag == "hr":
                    self._close({"p"})
            return
        if tag in BLOCKS or tag in DROPPED or tag in SUSPECT:
            self._close({"p"})
        for group in CLOSED_BY_NEXT:
            if tag in group:
                self._close(group)
        suspect = tag in SUSPECT or _suspect(attrs)
        dropped = tag in DROPPED or _boilerplate(attrs)
        main = tag in MAIN_TAGS or dict(attrs).get("role") == "main"
        if main and tag in MAIN_TAGS and not self.at.dropped:
            suspect = False
            words = _WORD.findall(" ".join(v or "" for k, v in attrs if k in ("class", "id")).lower())
            dropped = bool({"comment", "comments", "ad", "ads", "advert"} & set(words))
        # the header of an article is part of it
        if tag == "header" and self.at.inside:
            dropped = suspect = False
        dropped = dropped or self.at.dropped
        self.at = Node(tag, self.at, dropped, suspect, main and not dropped)
        self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tags):
        """End the nearest open element of ``tags`` below the nearest container."""
        if not any(self.open[tag] for tag in tags):
            return
        node = self.at
        while node.tag not in tags:
            if node.parent is None or (node.tag in BLOCKS and node.tag != "p"):
                return
            node = node.parent
        self._end(node)

    def handle_endtag(self, tag):
        if tag in ("body", "html") or not self.open[tag]:
            return
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self._end(node)
                return
            if node.tag in MAIN_TAGS and tag not in BLOCKS:
                return
            node = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _text(node: Node, out: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.dropped:
            if item.tag in BLOCKS:
                out.append("\n\0")
                stack.append("\n\0")
            stack.extend(reversed(item.children))


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below ``nodes``, in page order, without empty ones."""
    out: list[str] = []
    for node in nodes:
        _text(node, out)
        out.append("\n\0")
    parts = (_BLANKS.sub(" ", p.replace("\0", "")).strip() for p in "".join(out).split("\n\0"))
    return [p for p in parts if p]


def _score(root: Node) -> list[Node]:
    """Give points to all containers; returns them in page order."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped)
    commas: dict[int, int] = {}
    for node in order:
        node.points = node.own = node.held = 0.0
    for node in reversed(order):
        own = [c for c in node.children if isinstance(c, str)]
        inner = [c for c in node.children if isinstance(c, Node) and not c.dropped]
        node.chars = sum(len(t.strip()) for t in own) + sum(c.chars for c in inner)
        node.linked = node.chars if node.tag == "a" else sum(c.linked for c in inner)
        commas[id(node)] = sum(
            t.count(",") + t.count("，") + t.count("、") for t in own
        ) + sum(commas[id(c)] for c in inner)
    for node in order:
        leaf = node.tag in PARAGRAPHS or (
            node.tag in BLOCKS
            and any(isinstance(c, str) and c.strip() for c in node.children)
        )
        if leaf and node.chars:
            points = (1 + commas[id(node)] + node.chars / 100) * (1 - node.linked / node.chars)
            node.own = points
            up, share = node.parent if node.tag in PARAGRAPHS else node, 1.0
            while up is not None and share > LEAST_SHARE:
                up.points += points * share
                up, share = up.parent, share / 2
    for node in reversed(order):
        node.held += node.own
        if node.parent is not None:
            node.parent.held += node.held
    return order


def _settle(root: Node) -> list[Node]:
    """Drop the suspects, but not those that hold the main text: an article or main with
    no less than the text outside suspects, where none is outside; or most of the page's
    points, with a first heading or with nothing outside. What speaks for an element is
    judged anew after each that stays. Returns the scored containers in page order."""
    order = _score(root)
    if not any(n.suspect for n in order):
        return order
    named, heads = set(), set()  # elements that hold a main element with text; an h1
    for node in reversed(order):
        if node.named and node.held or id(node) in named:
            named |= {id(node), id(node.parent)}
        if node.tag == "h1" or id(node) in heads:
            heads |= {id(node), id(node.parent)}
    place = {id(node): i for i, node in enumerate(order)}
    below: set[int] = set()  # main elements and all below, as far as opened
    outer: list[Node] = []  # suspects that nothing open is below of, if they can stay
    rest, main_text_open, main_open = 0.0, False, False
    todo = [root]
    while True:
        # each element is opened once: its own points count outside of suspects
        while todo:
            node = todo.pop()
            if node.named or id(node.parent) in below:
                below.add(id(node))
            if node.suspect:
                if node.held > 0 and (id(node) in named or 2 * node.held > root.held):
                    outer.append(node)
                continue
            rest += node.own
            main_open = main_open or node.named
            main_text_open = main_text_open or (node.own > 0 and id(node) in below)
            todo.extend(c for c in node.children if isinstance(c, Node) and not c.dropped)
        stay = [
            n for n in outer
            if (id(n) in named and not main_text_open and n.held >= rest)
            or (
                (id(n) in below or not main_open)
                and 2 * n.held > root.held
                and (id(n) in heads or not rest)
            )
        ]
        if not stay:
            break
        node = max(stay, key=lambda n: (n.held, -place[id(n)]))
        outer.remove(node)
        todo.append(node)
        # wrappers of the same text stay together
        while node is not None:
            node.suspect = False
            inner = [c for c in node.children if isinstance(c, Node) and not c.dropped]
            node = next((c for c in inner if c.held == node.held), None)
    for node in order:
        node.dropped = node.suspect or (node.parent is not None and node.parent.dropped)
    return _score(root)


def _headed(node: Node) -> bool:
    """Whether all text of an element is headings, whatever wraps them."""
    stack: list[Node | str] = [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            if item.strip():
                return False
        elif not item.dropped and item.tag not in HEADINGS:
            stack.extend(item.children)
    return True


def main_text(html: str | None) -> str:
    """The main text of a page: its blocks joined by line breaks, "" if there is none."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    order = _settle(tree.root)

    def worth(node: Node) -> float:
        return node.points * (1 - node.linked / node.chars) if node.chars else 0.0

    containers = [n for n in order if n.points > 0]
    if not containers:
        return "\n".join(blocks([tree.root]))
    best = max(containers, key=worth)
    # a part of a declared article or main element stands for the whole of it
    up = best
    while up is not None:
        if up.named:
            best = up
        up = up.parent
    if best.parent is None:
        return "\n".join(blocks([best]))
    least = worth(best) * SIBLING_SHARE
    kept = []
    for node in best.parent.children:
        if not isinstance(node, Node) or node.dropped:
            continue
        density = node.linked / node.chars if node.chars else 1.0
        reads = node.tag in PARAGRAPHS and node.chars >= SIBLING_CHARS
        if not best.named:
            # no element says where the main text ends
            reads = node.tag in PARAGRAPHS or node.tag in LISTS or _headed(node)
        reads = reads and density < SIBLING_LINKS
        if node is best or worth(node) >= least > 0 or reads:
            kept.append(node)
    return "\n".join(blocks(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row of ``pages``.

    Null and empty html give an empty text; so do pages of boilerplate tags alone. Rows are
    independent: repeated rows and null page_ids or urls are kept.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": batch.column(0),
                    "url": batch.column(1),
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                },
                _SCHEMA,
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        each, "page_id long, url string, text string, n_chars long"
    )


_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())]
)
