"""HTML extraction by differencing each page with the page of nearest URL.

Pages are put in order of (host, path); the nearest of a page is whichever of
its two neighbours on the host has the longer common beginning of the path, the
one before it if both have the same.  A neighbour with exactly the same lines
says nothing about what is the site's and what the page's: it is passed over.
With ``past_equal``, as the query does it, the search goes on from there to the
next page of the host whose lines differ, however many are equal between.
The text lines of the page and its nearest are aligned by longest common
subsequence, and the shared lines are deleted.  A page without a neighbour
keeps all its lines.

Text lines: the body without comments, scripts, styles and templates, split at
block elements and line breaks, entities decoded, white space collapsed, blank
lines left out.

Pages are cut to lines where they are read, so that only their text moves, once:
ranges of (host, path, url, page_id), whose bounds come from a sample of keys,
go to tasks, which see them in order.  A hot host is many ranges.  A page whose
neighbours are in its range is done there; for the pages at both ends of a
range, the one or two pages that lie next beyond its border are looked up.

Null html gives an empty text; pages with a null or malformed URL are of one
host with an empty name; repeated rows are all kept, each a page; further
columns are not read.  An empty table gives an empty result.  Of several
longest subsequences the one is taken that uses the last lines possible.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of an alignment that are held at once, and keys sampled for each range.
CELLS = 1 << 22
SAMPLED = 30
FIELDS = ["part int", "state string", "begins boolean", "ends boolean", "host string", "path string", "url string", "page_id long", "partner_id long", "text string", "lines long", "deleted long", "sign long", "run int"]
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
RESULT = ["page_id", "url", "partner_id", "text", "lines", "deleted"]

_HIDDEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|head|svg)\b[^>]*>.*?(?:</\1\s*>|$)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|body|br|caption|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|legend|li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")


def text_lines(source: str | None) -> list[str]:
    """The visible lines of a page; see the module's docstring."""
    if not source:
        return []
    text = _TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", source)))
    if "&" in text:
        text = entities.unescape(text)
    return [line for raw in text.split("\n") if (line := " ".join(raw.split()))]


def shared_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Equal beginnings and ends are always part of one; lines that the other
    page lacks are never.  What is left is solved a row at a time; of a large
    table every some rows are kept, and the way back computes the others anew.
    """
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    m = 0
    while m < min(len(a), len(b)) - n and a[-1 - m] == b[-1 - m]:
        m += 1
    inner = {v: k for k, v in enumerate(set(a[n : len(a) - m]) & set(b[n : len(b) - m]))}
    x = [i for i in range(n, len(a) - m) if a[i] in inner]
    y = [inner[v] for v in b[n : len(b) - m] if v in inner]
    own = np.array([inner[a[i]] for i in x], np.int64)

    def next_row(row: np.ndarray, v: int) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.int32)
        out[1:] = np.maximum.accumulate(np.maximum(np.where(own == v, row[:-1] + 1, 0), row[1:]))
        return out

    step = max(1, min(len(y), max(CELLS // (len(x) + 1), int(len(y) ** 0.5))))
    starts = [np.zeros(len(x) + 1, np.int32)]
    for k in range(0, len(y) - step, step):
        row = starts[-1]
        for v in y[k : k + step]:
            row = next_row(row, v)
        starts.append(row)
    at, i, j = [], len(y), len(x)
    for k in reversed(range(len(starts))):
        first = k * step
        table = [starts.pop()]
        for v in y[first:i]:
            table.append(next_row(table[-1], v))
        while i > first and j:
            if table[i - first][j] == table[i - 1 - first][j]:
                i -= 1
            elif table[i - first][j] == table[i - first][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                at.append(x[j])
        if not j:
            break
    return [*range(n), *at[::-1], *range(len(a) - m, len(a))]


def nearest(path: str, before: tuple | None, after: tuple | None) -> tuple | None:
    """Of two pages, each a tuple that begins with its path, the one of longer common beginning; the first of equals."""
    near = [x for x in (before, after) if x is not None]
    return max(near, key=lambda x: len(commonprefix((path, x[0])))) if near else None


class _Rows:
    """Columns of the result, a batch at a time."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, *row: object) -> None:
        self.rows.append(row)
        self.size += len(row[9] or "")

    def full(self) -> bool:
        return self.size > 4 << 20 or len(self.rows) > 4096

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(FIELDS)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[f.split()[1]]) for c, f in zip(columns, FIELDS)], names=[f.split()[0] for f in FIELDS])


def _own_text(text: str, other: tuple | None, known: dict) -> tuple[str, int, int]:
    """(text without the lines shared with the other page, lines, lines deleted)."""
    if other not in known:
        lines = text.split("\n") if text else []
        gone = set(shared_lines(lines, other[2].split("\n") if other[2] else [])) if other else ()
        known[other] = "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
    return known[other]


def _part_batches(bounds: list[tuple]):
    """Pages as (part, host, path, url, page_id, text), the part from the place among the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                keys = zip(*(rows[c].to_pylist() for c in ("host", "path", "url", "page_id")))
                part = [bisect.bisect_right(bounds, _key(*k)) for k in keys]
                text = ["\n".join(text_lines(h)) for h in rows["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(rows[c] for c in ("host", "path", "url", "page_id")), pa.array(text, pa.string())], names=["part", "host", "path", "url", "page_id", "text"])

    return run


def _key(host: str, path: str, url: str | None, page_id: int | None) -> tuple:
    return host, path, url is not None, url or "", page_id is not None, page_id or 0


def _sign(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _run_batches(past_equal: bool, want: str):
    """Pages of a part in order: those whose neighbours are all there are done; the part's first and last run stay open.

    ``want`` says which rows are given: "done", "open" or "edge".

    A run is a sequence of pages of one host with the same lines.  Edges are
    the pages next to a border that another part's open run may need: the first
    page, that of the second run, the last page of the last run but one, and
    the last page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, number = _Rows(), 0, 0
        before: tuple | None = None  # (path, id, text) of the page before the run, if it is of the same host
        rows: list[tuple] = []
        host = text = None
        last: tuple = ()

        def close(after: tuple | None, end: bool) -> Iterator[pa.RecordBatch]:
            state = "only" if end and number == 1 else "last" if end else "first" if number == 1 else ""
            known: dict = {}
            if want != ("open" if state else "done"):
                return
            for k, (path, url, page_id) in enumerate(rows):
                if state:
                    out.add(part, state, k == 0, k == len(rows) - 1, host, path, url, page_id, None, text, 0, 0, _sign(text), number)
                else:
                    near = nearest(path, before if past_equal or k == 0 else None, after if past_equal or k == len(rows) - 1 else None)
                    out.add(part, "", None, None, None, None, url, page_id, near and near[1], *_own_text(text, near, known), None, None)
                if out.full():
                    yield out.batch()

        def edge(name: str, page: tuple, own: str) -> None:
            if want == "edge":
                out.add(part, name, None, None, own, page[0], None, page[1], None, page[2], 0, 0, _sign(page[2]), number)

        for batch in batches:
            for p, h, path, url, page_id, t in zip(*(batch[c].to_pylist() for c in ("part", "host", "path", "url", "page_id", "text"))):
                page = (path, page_id, t)
                if number == 0:
                    part, number, host, text = p, 1, h, t
                    edge("head", page, h)
                elif h != host or t != text:
                    yield from close(page if h == host else None, False)
                    before = last if h == host else None
                    before_host = host
                    number, host, text, rows = number + 1, h, t, []
                    if number == 2:
                        edge("second", page, h)
                rows.append((path, url, page_id))
                last = page
        if number:
            if number > 1:
                edge("prelast", before if before else ("", None, ""), host if before else f"{before_host}\n")
            edge("tail", last, host)
            yield from close(None, True)
        yield out.batch()

    return run


def _border_pages(edges: list, past_equal: bool) -> list[tuple[int, str, str, int, str]]:
    """(part, state, side, part of the page, edge) for each open run and side that has a page of its host with other lines.

    ``edges`` holds (part, edge, host, sign, runs) of all parts, four rows at most for each.
    """
    parts: dict[int, dict] = {}
    for part, name, host, sign, runs in edges:
        parts.setdefault(part, {})[name] = (host, sign)
        parts[part]["runs"] = runs if name == "tail" else parts[part].get("runs", 1)
    order = sorted(parts)
    out = []

    def beyond(i: int, step: int, host: int, sign: int) -> tuple[int, str] | None:
        near, next_ = ("tail", "prelast") if step < 0 else ("head", "second")
        j = i + step
        while 0 <= j < len(order):
            other = parts[order[j]]
            if other[near][0] != host:
                return None
            if other[near][1] != sign:
                return order[j], near
            if not past_equal:
                return None
            if other["runs"] > 1:
                return (order[j], next_) if other[next_][0] == host else None
            j += step
        return None

    for i, part in enumerate(order):
        own = parts[part]
        if own["runs"] == 1:
            sides = [("only", "before", beyond(i, -1, *own["head"])), ("only", "after", beyond(i, 1, *own["tail"]))]
        else:
            inner = lambda name, near: (part, name) if own[name][0] == own[near][0] else None  # noqa: B023, E731
            sides = [("first", "before", beyond(i, -1, *own["head"])), ("first", "after", inner("second", "head")), ("last", "before", inner("prelast", "tail")), ("last", "after", beyond(i, 1, *own["tail"]))]
        out += [(part, state, side, *page) for state, side, page in sides if page]
    return out


def _border_batches(past_equal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        columns = list(zip(*_border_pages(edges, past_equal))) or [()] * 5
        kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["part", "state", "side", "of", "edge"])

    return run


def _open_batches(past_equal: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = [], {}
            for page_id, url, path, text, begins, ends, before, after in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "path", "text", "begins", "ends", "before", "after"))):
                sides = [x and (x["path"], x["page_id"], x["text"]) if past_equal or at else None for x, at in ((before, begins), (after, ends))]
                near = nearest(path, *sides)
                out.append((page_id, url, near and near[1], *_own_text(text, near, known.setdefault(text, {}))))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=RESULT)

    return run


def _bounds(keys: DataFrame, parts: int) -> list[tuple]:
    """Keys that divide the pages into so many ranges of about equal size, from a sample of a number that depends on the parts only."""
    n = keys.count()
    sample = keys if n <= SAMPLED * parts else keys.sample(SAMPLED * parts / n, seed=7)
    rows = sorted(_key(*r) for r in sample.toLocalIterator())
    return sorted({rows[len(rows) * i // parts] for i in range(1, parts)}) if rows else []


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", past_equal: bool = False, parts: int | None = None) -> DataFrame:
    """(page_id, url, partner_id, text, lines, deleted): each page's own lines; see the module's docstring."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    keys = [host.alias("host"), path.alias("path"), F.col(url_col).alias("url"), F.col(id_col).cast("long").alias("page_id")]
    rows = pages.select(*keys, F.col(html_col).alias("html"))
    placed = rows.mapInArrow(_part_batches(_bounds(pages.select(*keys), parts)), "part int, host string, path string, url string, page_id long, text string")
    ordered = placed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "host", "path", "url", "page_id", "text")
    found = lambda want: ordered.mapInArrow(_run_batches(past_equal, want), ", ".join(FIELDS))
    # the three read one exchange; of the edges, four rows a range, those that open runs need are found in one task
    border = found("edge")
    light = border.select("part", "state", F.xxhash64("host").alias("host"), "sign", "run").repartition(1)
    asked = light.mapInArrow(_border_batches(past_equal), "part int, state string, side string, of int, edge string")
    page = border.select(F.col("part").alias("of"), F.col("state").alias("edge"), F.struct("path", "page_id", "text").alias("page"))
    sides = asked.join(page, ["of", "edge"]).groupBy("part", "state").agg(*(F.first(F.when(F.col("side") == s, F.col("page")), ignorenulls=True).alias(s) for s in ("before", "after")))
    # a run may hold as many pages as its part, all with the same neighbours
    opened = found("open").join(sides, ["part", "state"], "left")
    settled = opened.select("page_id", "url", "path", "text", "begins", "ends", "before", "after").mapInArrow(_open_batches(past_equal), "page_id long, url string, partner_id long, text string, lines long, deleted long")
    return found("done").select(*RESULT).unionByName(settled)
