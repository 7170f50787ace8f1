"""HTML tree to Markdown: ATX headings, fenced code, dash bullets, asterisk emphasis."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from loomtext.functions.html5 import Node, parse

BLOCK = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol output p pre section summary table tbody td tfoot th thead tr ul #root".split())
_ESCAPES = [(re.compile(p), r) for p, r in ((r"\\", r"\\\\"), (r"\*", r"\\*"), (r"^-", r"\\-"), (r"^\+ ", r"\\+ "), (r"^(=+)", r"\\\1"), (r"^(#{1,6}) ", r"\\\1 "), (r"`", r"\\`"), (r"^~~~", r"\\~~~"), (r"\[", r"\\["), (r"\]", r"\\]"), (r"^>", r"\\>"), (r"_", r"\\_"), (r"^(\d+)\. ", r"\1\\. "))]


def escape(text: str) -> str:
    for pattern, new in _ESCAPES:
        text = pattern.sub(new, text)
    return text


def table_grid(table: Node) -> list[list[str]]:
    """Cell texts; a column span leaves blanks, a row span repeats its text in the leftmost free column of later rows."""
    grid, carried = [], []
    for row in (n for n in table.walk() if n.tag == "tr"):
        cells = [text for text, _ in carried]
        carried = [(text, left - 1) for text, left in carried if left > 1]
        for cell in (c for c in row.children if c.tag in ("td", "th")):
            text = " ".join(cell.text().split()).replace("|", "\\|")
            span, down = (int(m[0]) if (m := re.match(r"\d+", cell.attrs.get(a, ""))) else 1 for a in ("colspan", "rowspan"))
            cells += [text, *[""] * (max(span, 1) - 1)]
            if down > 1:
                carried.append((text, down - 1))
        if cells:
            grid.append(cells)
    return grid


def table_markdown(grid: list[list[str]]) -> str:
    if not grid:
        return ""
    width = max(map(len, grid))
    rows = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in grid]
    return "\n".join([rows[0], "| " + " | ".join(["---"] * width) + " |", *rows[1:]])


def _join(parts: list[str]) -> str:
    """The parts with the larger number of line ends between each two, two at most."""
    out: list[str] = []
    ends = 0
    for part in parts:
        tail = part.lstrip("\n")
        breaks = min(2, max(ends, len(part) - len(tail)))
        if not tail:  # line ends only
            ends = breaks
            continue
        core = tail.rstrip("\n")
        out += ["\n" * breaks, core]
        ends = len(tail) - len(core)
    return "".join(out) + "\n" * ends


#: Elements whose children are not rendered one by one.
_WHOLE = frozenset("script style head title meta link input pre table img br hr code".split())


class _Renderer:
    """Markdown of a tree, children before their parents, so that no depth of nesting is too deep."""

    def __init__(self, images: bool) -> None:
        self.images = images
        self.done: dict[int, str] = {}
        self.place: dict[int, int] = {}
        self.number: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        self.last: dict[int, int] = {}

    def render(self, root: Node) -> str:
        order, stack = [], [root]
        self.depth[id(root)] = 0
        while stack:
            node = stack.pop()
            order.append(node)
            if node.tag in _WHOLE:
                continue
            below = self.depth[id(node)] + (node.tag in ("ul", "ol"))
            n = 0
            for i, child in enumerate(node.children):
                self.place[id(child)], self.number[id(child)], self.depth[id(child)] = i, n, below
                n += bool(child.tag)
                if child.tag:
                    self.last[id(node)] = i
            stack.extend(node.children)
        for node in reversed(order[1:]):
            self.done[id(node)] = self._one(node)
        return self._inner(root)

    def _inner(self, node: Node, but: Node | None = None) -> str:
        return _join([self.done[id(c)] for c in node.children if c is not but])

    def _item(self, node: Node) -> str:
        parent = node.parent
        body = re.sub(r"\n", "\n    ", self._inner(node).strip("\n"))
        box = next((n for n in node.walk() if n.tag == "input" and n.attrs.get("type") == "checkbox"), None)
        mark = ("[x] " if "checked" in box.attrs else "[ ] ") if box is not None else ""
        prefix = "- "
        if parent is not None and parent.tag == "ol":
            first = parent.attrs.get("start", "")
            prefix = f"{(int(first) if first.isdigit() else 1) + self.number[id(node)]}. "
        after = "\n" if parent is not None and self.last.get(id(parent), -1) > self.place[id(node)] else ""
        return "  " * max(self.depth[id(node)] - 1, 0) + prefix + mark + body.strip() + after

    def _text(self, node: Node) -> str:
        text = re.sub(r"[ \t\r\n\f]+", " ", node.value)
        parent = node.parent
        if parent is not None and parent.tag in BLOCK:
            at = self.place[id(node)]
            if at == 0 or parent.children[at - 1].tag in BLOCK or parent.children[at - 1].tag == "br":
                text = text.lstrip(" ")
            if at == len(parent.children) - 1 or parent.children[at + 1].tag in BLOCK:
                text = text.rstrip(" ")
        return escape(text)

    def _one(self, node: Node) -> str:
        tag = node.tag
        if not tag:
            return self._text(node)
        if tag in ("script", "style", "head", "title", "meta", "link", "input"):
            return ""
        if tag == "pre":
            code = next((n for n in node.walk() if n.tag == "code"), None)
            if code is not None:
                lang = re.search(r"(?:language-|lang-)(\w+)", code.attrs.get("class", ""))
                return f"\n\n```{lang[1] if lang else ''}\n{code.text().strip()}\n```\n\n"
            return f"\n\n{node.text().strip()}\n\n"
        if tag == "table":
            return f"\n\n{table_markdown(table_grid(node))}\n\n"
        if tag == "img":
            alt, src, title = (node.attrs.get(k, "") for k in ("alt", "src", "title"))
            if self.images:
                return f"![{alt}]({src}{f' {chr(34)}{title}{chr(34)}' if title else ''})" if src else ""
            return f"[Image: {alt}]" if alt else ""
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n* * *\n\n"
        if tag == "code":
            text = node.text().replace("\n", " ")
            fence = "`"
            while fence in re.findall("`+", text):
                fence += "`"
            return f"{fence}{text}{fence}" if text.strip() else ""
        if tag == "li":
            return self._item(node)
        body = self._inner(node)
        if not body.strip() and tag not in ("td", "th"):
            return "\n\n" if tag in BLOCK else body
        if re.fullmatch("h[1-6]", tag):
            return f"\n\n{'#' * int(tag[1])} {body.strip()}\n\n"
        if tag in ("ul", "ol"):
            return f"\n{body}" if node.parent is not None and node.parent.tag == "li" else f"\n\n{body.strip(chr(10))}\n\n"
        if tag == "blockquote":
            quoted = "\n".join(f"> {line}".rstrip() if not line else f"> {line}" for line in body.strip().split("\n"))
            return f"\n\n{quoted}\n\n"
        if tag == "details":
            summary = next((n for n in node.walk() if n.tag == "summary"), None)
            rest = self._inner(node, summary).strip()
            return f"\n\n<details>\n<summary>{summary.text().strip() if summary is not None else 'Details'}</summary>\n\n{rest}\n\n</details>\n\n"
        if tag == "a":
            href, text = node.attrs.get("href", ""), body.strip()
            if not text:
                return ""
            title = node.attrs.get("title")
            return f"[{text}]({href}{f' {chr(34)}{title}{chr(34)}' if title else ''})" if href else body
        for tags, mark in ((("strong", "b"), "**"), (("em", "i"), "*"), (("del", "s", "strike"), "~~")):
            if tag in tags:
                lead, tail = body[: len(body) - len(body.lstrip())], body[len(body.rstrip()) :]
                return f"{lead}{mark}{body.strip()}{mark}{tail}"
        return f"\n\n{body.strip(chr(10))}\n\n" if tag in BLOCK else body


_POST = [
    (re.compile(r"\n{3,}"), "\n\n"),
    (re.compile(r"[ \t]+$", re.M), ""),
    (re.compile("¶"), ""),
    (re.compile(r"\[Link to this [^\]]*\](?:\([^)]*\))?"), ""),
    (re.compile(r"^(#{1,6} .*?)\s*\[[#§]?\]\(#[^)]*\)", re.M), r"\1"),
    (re.compile(r"([^\n])\n(#{1,6}\s)"), r"\1\n\n\2"),
    (re.compile(r"\\([\[\](){}])"), r"\1"),
]


def post_process(text: str) -> str:
    for pattern, new in _POST:
        text = pattern.sub(new, text)
    return text.strip()


def convert(source: str, images: bool = False) -> str:
    return post_process(_Renderer(images).render(parse(source)))


def resolve_links(text: str, base: str) -> str:
    """Relative link and image targets against the page's URL; http, fragment and mail targets stay."""

    def one(m: re.Match) -> str:
        target = m[2]
        if target.startswith(("http", "#", "mailto:")):
            return m[0]
        try:
            return f"{m[1]}({urljoin(base, target)})"
        except ValueError:
            return m[0]

    return re.sub(r"(!?\[[^\]]*\])\(([^)]+)\)", one, text)
