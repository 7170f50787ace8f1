"""A small tolerant HTML tree and the selectors that extraction needs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: A new element of the key's kind ends an open one of these, within the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """An element, or a text when ``tag`` is empty."""

    __slots__ = ("attrs", "children", "parent", "tag", "value")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, value: str = "") -> None:
        self.tag, self.attrs, self.value = tag, attrs or {}, value
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def walk(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if node.tag:
                yield node
                stack.extend(reversed(node.children))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.tag:
                stack.extend(reversed(node.children))
            else:
                out.append(node.value)
        return "".join(out)

    def html(self) -> str:
        """Inner markup."""
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):
                out.append(child)
            elif not child.tag:
                out.append(child.value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            else:
                attrs = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in child.attrs.items())
                out.append(f"<{child.tag}{attrs}>")
                if child.tag not in VOID:
                    stack.append(f"</{child.tag}>")
                    stack.extend(reversed(child.children))
        return "".join(out)

    def closest(self, tags: frozenset[str] | set[str]) -> Node | None:
        node: Node | None = self
        while node is not None and node.tag not in tags:
            node = node.parent
        return node

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.active: list[Node] = []

    def _close(self, index: int) -> None:
        del self.open[index:]

    def _reopen(self) -> None:
        """Formatting elements that another end tag closed go on in the next block."""
        for i, old in enumerate(self.active):
            if old not in self.open:
                new = Node(old.tag, dict(old.attrs))
                self.open[-1].add(new)
                self.open.append(new)
                self.active[i] = new

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "p":
                    self._close(i)
                    break
                if self.open[i].tag in ("td", "th", "table", "button"):
                    break
        if tag in ENDS:
            ended, stops = ENDS[tag]
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in stops:
                    break
                if self.open[i].tag in ended:
                    self._close(i)
        if tag == "a":
            for old in [x for x in self.active if x.tag == "a"]:
                self.active.remove(old)
                if old in self.open:
                    self._close(self.open.index(old))
        if tag not in CLOSES_P and tag not in ("html", "head", "body", "meta", "link", "title", "script", "style"):
            self._reopen()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else None)
        self.open[-1].add(node)
        if tag not in VOID:
            self.open.append(node)
            if tag in FORMATTING:
                self.active.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if tag in FORMATTING:
                    self.active = [x for x in self.active if x is not self.open[i]]
                self._close(i)
                return
        if tag == "p":
            self.open[-1].add(Node("p"))

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._reopen()
        self.open[-1].add(Node("", value=data))


def parse(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


_PART = re.compile(r'([a-zA-Z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[([\w-]+)(?:(\*?=)"?([^"\]]*)"?)?\]')


def _compile(simple: str) -> list[tuple]:
    return [m.groups() for m in _PART.finditer(simple)]


def _fits(node: Node, parts: list[tuple]) -> bool:
    for tag, cls, ident, attr, op, value in parts:
        if tag and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr:
            own = node.attrs.get(attr)
            if own is None or (op == "=" and own != value) or (op == "*=" and value not in own):
                return False
    return True


class Selector:
    """A comma list of simple selectors, each with at most descendant combinators."""

    def __init__(self, text: str) -> None:
        self.choices = [[_compile(s) for s in one.split()] for one in text.split(",")]

    def matches(self, node: Node) -> bool:
        for *above, own in self.choices:
            if not _fits(node, own):
                continue
            up, rest = node.parent, list(above)
            while up is not None and rest:
                if _fits(up, rest[-1]):
                    rest.pop()
                up = up.parent
            if not rest:
                return True
        return False

    def all(self, root: Node) -> list[Node]:
        return [n for n in root.walk() if self.matches(n)]

    def first(self, root: Node) -> Node | None:
        return next((n for n in root.walk() if self.matches(n)), None)
