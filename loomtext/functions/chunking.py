"""Splitting Markdown into token-bounded chunks."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

Count = Callable[[str], int]
FENCE = "`" * 3


def estimate(text: str) -> int:
    """A token for each four characters, rounded up."""
    return math.ceil(len(text) / 4)


def _pack(parts: list[str], join: str, limit: int, count: Count) -> list[str]:
    out, held = [], ""
    for part in parts:
        both = f"{held}{join}{part}" if held else part
        if held and count(both) > limit:
            out.append(held)
            held = part
        else:
            held = both
    return [x for x in [*out, held] if x.strip()]


def sections(text: str) -> list[str]:
    """Cut before headings of level 1 to 4 outside code fences."""
    out, now, fenced = [], [], False
    for line in text.split("\n"):
        if line.startswith(FENCE):
            fenced = not fenced
        if not fenced and re.match(r"#{1,4}\s", line) and "\n".join(now).strip():
            out.append("\n".join(now))
            now = []
        now.append(line)
    return [x for x in [*out, "\n".join(now)] if x.strip()]


def split_fixed(text: str, limit: int, count: Count) -> list[str]:
    return _pack(text.split("\n"), "\n", limit, count)


def split_heading(text: str) -> list[str]:
    return [x for p in re.split(r"(?m)(?=^#{1,3}\s)", text) if (x := p.strip())]


def merge_fences(chunks: list[str], limit: int, count: Count, join: str = "\n\n") -> list[str]:
    """A chunk that ends within a fence takes the next one in, up to one and a half times the limit; ``join`` is what was between them."""
    out, i = [], 0
    while i < len(chunks):
        if chunks[i].count(FENCE) % 2 and i + 1 < len(chunks) and count(both := f"{chunks[i]}{join}{chunks[i + 1]}") <= 1.5 * limit:
            out.append(both)
            i += 2
        else:
            out.append(chunks[i])
            i += 1
    return out


def overlap_suffix(text: str, limit: int, count: Count) -> str:
    """The longest run of last words within the limit, up to the first that exceeds it."""
    words, best = text.split(), ""
    for i in range(len(words) - 1, -1, -1):
        tail = " ".join(words[i:])
        if count(tail) > limit:
            break
        best = tail
    return best


def split(text: str, strategy: str = "semantic", limit: int = 1500, overlap: int = 100, keep_code: bool = True, count: Count = estimate) -> list[str]:
    if strategy == "semantic":
        chunks = _pack(sections(text), "\n\n", limit, count)
    elif strategy == "heading":
        chunks = split_heading(text)
    elif strategy == "paragraph":
        chunks = _pack([p for p in re.split(r"\n\n+", text) if p.strip()], "\n\n", limit, count)
    elif strategy == "fixed":
        chunks = split_fixed(text, limit, count)
    else:
        raise ValueError(f"no strategy {strategy}")
    if keep_code:
        chunks = merge_fences(chunks, limit, count, "\n" if strategy == "fixed" else "\n\n")
    chunks = [piece for c in chunks for piece in ([c] if count(c) <= limit else split_fixed(c, limit, count))]
    if overlap > 0 and len(chunks) > 1:
        tails = [overlap_suffix(c, overlap, count) for c in chunks]
        chunks = [chunks[0], *(f"{t}\n{c}" if t else c for t, c in zip(tails, chunks[1:]))]
    return chunks


def chunk_id(url: str, index: int, text: str) -> str:
    return hashlib.sha256(f"{url}:{index}:{text[:64]}".encode()).hexdigest()[:16]


def heading_places(text: str, headings: list[tuple[int, str]]) -> list[tuple[int, str, int]]:
    """(level, title, place) of the headings that the text has, each at its first place."""
    first: dict[str, int] = {}
    return [(level, title, first[title]) for level, title in headings if first.setdefault(title, text.find(title)) >= 0]


def path_at(chunk: str, text: str, places: list[tuple[int, str, int]]) -> list[str]:
    """Headings above the chunk's place by level; a shallower one leaves deeper levels as they are."""
    at = text.find(chunk[:50]) if places else -1
    if at < 0:
        return []
    path = {level: title for level, title, place in places if place <= at + len(chunk[:50])}
    return [path[k] for k in sorted(path)]


def heading_path(chunk: str, text: str, headings: list[tuple[int, str]]) -> list[str]:
    return path_at(chunk, text, heading_places(text, headings))
