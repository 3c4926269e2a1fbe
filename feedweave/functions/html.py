"""A small HTML tree for the page jobs: stdlib tokenizer, lenient nesting, simple selectors."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# A start tag of these closes an open paragraph.
BLOCK = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
# start tag -> (open tags it closes, tags that stop the search)
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
P_STOP = frozenset("table td th button object caption".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self):
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self):
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(node.elements()[::-1])

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                stack.extend(item.children[::-1])
            else:
                out.append(item)
        return "".join(out)

    def all(self, *tags: str) -> list["Node"]:
        return [n for n in self.walk() if n.tag in tags]

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def attached(self, root: "Node") -> bool:
        node = self
        while node is not None and node is not root:
            node = node.parent
        return node is root


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.open = [self.root]

    def _close(self, tags, stop) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self._close(("p",), P_STOP)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        values = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        node = Node(tag, values, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


SIMPLE = re.compile(r"([A-Za-z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([~^*$]?=)['\"]?([^'\"\]]*)['\"]?)?\]")


@lru_cache(maxsize=4096)
def _compile(selector: str):
    """Alternatives, each a list of compound selectors from outer to inner."""
    return [[SIMPLE.findall(part) for part in alt.split()] for alt in re.split(r",(?![^\[]*\])", selector) if alt.strip()]


def _is(node: Node, compound) -> bool:
    for tag, ident, cls, name, op, value in compound:
        if tag and tag != "*" and node.tag != tag.lower():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if name:
            have = node.attrs.get(name)
            if have is None:
                return False
            if op == "=" and have != value or op == "^=" and not have.startswith(value) or op == "*=" and value not in have:
                return False
    return True


def _fits(node: Node, parts) -> bool:
    if not _is(node, parts[-1]):
        return False
    rest, up = len(parts) - 2, node.parent
    while rest >= 0 and up is not None:
        if _is(up, parts[rest]):
            rest -= 1
        up = up.parent
    return rest < 0


def select(root: Node, selector: str) -> list[Node]:
    alternatives = _compile(selector)
    return [n for n in root.walk() if any(_fits(n, parts) for parts in alternatives)]


def first(root: Node, selector: str) -> Node | None:
    alternatives = _compile(selector)
    return next((n for n in root.walk() if any(_fits(n, parts) for parts in alternatives)), None)


def squeeze(text: str) -> str:
    return " ".join(text.split())
