"""HTML pages to structured pages: one parse for all fields, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.functions import columns as C
from loomtext.functions.html5 import VOID, Node, Selector, parse
from loomtext.functions.markdown import convert, resolve_links

NOISE = Selector(
    'script, style, iframe, noscript, aside, footer, header, nav, .modal, .overlay, .popup, .pagination, .breadcrumb, .subscribe, .newsletter, .disqus, #comments, .comments, '
    '.share-buttons, .social-share, .ads, .ad, .advertisement, [class*="ad-"], .gdpr, .cookie-consent, .cookie-banner, .nav, .navigation, .sidebar, '
    '[role="complementary"], [role="navigation"], [role="banner"]'
)
CONTENT = [Selector(s) for s in ("article", "main", '[role="main"]', *(f".{c}" for c in ("markdown-body", "documentation", "doc-content")), *(f".{c}-content" for c in ("post", "article", "entry")), ".readme", "#readme", ".content", "#content")]
API = Selector(".api-content, .endpoint, .method-section, .operation")
METHOD = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)"
PRE, HEADINGS, DENSE = Selector("pre code, pre"), {f"h{i}" for i in range(1, 7)}, Selector("div, section")

SCHEMA = (
    "url string, title string, description string, markdown string, html string, text string, "
    "code_blocks array<struct<language:string,code:string,context:string>>, headings array<struct<level:int,text:string,id:string>>, "
    "links array<struct<href:string,text:string,is_internal:boolean>>, "
    "metadata struct<author:string,published_date:string,modified_date:string,language:string,framework:string,library:string,og_image:string,canonical:string,site_name:string,type:string,version:string,tags:array<string>>, "
    "images array<struct<src:string,alt:string,title:string,width:int,height:int,context:string>>, error string, has_article boolean, has_readme boolean, body string"
)


def _meta(metas: dict[str, str], *names: str) -> str | None:
    return next((metas[n] for n in names if n in metas), None)


def _metas(root: Node) -> dict[str, str]:
    """First content of each name or property."""
    out: dict[str, str] = {}
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get("content"):
            for name in (node.attrs.get("name"), node.attrs.get("property")):
                if name:
                    out.setdefault(name, node.attrs["content"])
    return out


def _resolve(base: str, href: str) -> str | None:
    try:
        full = urljoin(base, href.strip())
        return full if urlsplit(full).scheme else None
    except ValueError:
        return None


def _container(root: Node, body: Node, focus: str) -> list[Node]:
    if focus == "code":
        found = [n.parent for n in Selector("pre, .highlight, .code-block").all(root) if n.parent is not None]
        if found:
            return list(dict.fromkeys(found))
    if focus == "api" and (own := API.first(root)) is not None:
        return [own]
    for selector in CONTENT:
        own = selector.first(root)
        if own is not None and len(own.text()) > 200:
            return [own]
    best, top, sizes = None, 0.0, _sizes(body)
    for node in DENSE.all(body):
        size, markup, paragraphs, codes = sizes[id(node)]
        if size >= 200:
            score = size / max(markup, 1) * (1 + 0.1 * paragraphs + 0.2 * codes)
            if score > top:
                best, top = node, score
    return [best if best is not None else body]


def _sizes(root: Node) -> dict[int, tuple[int, int, int, int]]:
    """For each element the length of its trimmed text and of its markup, and the paragraphs and codes in it; children first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(node.children)
    out: dict[int, tuple[int, int, int, int]] = {}
    texts: dict[int, tuple[int, int, int]] = {}  # length, white space at the beginning and at the end
    for node in reversed(order):
        if not node.tag:
            v = node.value
            texts[id(node)] = len(v), len(v) - len(v.lstrip()), len(v) - len(v.rstrip())
            out[id(node)] = 0, len(v) + 4 * v.count("&") + 3 * (v.count("<") + v.count(">")), 0, 0
            continue
        length = lead = trail = markup = paragraphs = codes = 0
        for child in node.children:
            n, first, last = texts[id(child)]
            lead = lead + first if lead == length else lead
            trail = trail + n if last == n else last
            length += n
            _, m, ps, cs = out[id(child)]
            markup += m
            if child.tag:
                attrs = sum(len(k) + len(v) + 4 * v.count("&") + 5 * v.count(chr(34)) + 4 for k, v in child.attrs.items())
                markup += len(child.tag) + 2 + attrs + (0 if child.tag in VOID else len(child.tag) + 3)
            paragraphs += ps + (child.tag == "p")
            codes += cs + (child.tag in ("pre", "code"))
        texts[id(node)] = length, lead, trail
        out[id(node)] = max(0, length - lead - trail) if lead < length else 0, markup, paragraphs, codes
    return out


def _context(node: Node) -> str | None:
    around = node.closest({"section", "div"})
    titles = [n for n in around.walk() if n.tag in ("h1", "h2", "h3", "h4")] if around is not None else []
    return titles[-1].text().strip() or None if titles else None


def _code_blocks(parts: list[Node]) -> list[dict]:
    out = []
    for part in parts:
        for node in PRE.all(part):
            code = node.text().strip()
            if code:
                names = f"{node.attrs.get('class', '')} {node.parent.attrs.get('class', '') if node.parent is not None else ''}"
                lang = re.search(r"(?:language-|lang-|highlight-)(\w+)", names)
                out.append({"language": lang[1] if lang else None, "code": code, "context": _context(node)})
    return out


def _endpoints(parts: list[Node]) -> list[dict]:
    out = []
    for part in parts:
        for node in Selector(".opblock, .operation, [class*=endpoint], [class*=method]").all(part):
            text = node.text()
            method, path = re.search(METHOD + r"\b", text), re.search(r"/[\w\-/.{}:]+", text)
            if method and path:
                about = Selector(".opblock-summary-description, .description, p").first(node)
                note = about.text().strip() if about is not None else ""
                out.append(f"{method[1]} {path[0]}" + (f"\n# {note}" if note else ""))
    if not out:
        out = [" ".join(m) for part in parts for m in re.findall(METHOD + r"\s+(/[\w\-/.{}:?&=]+)", part.text())]
    return [{"language": "http", "code": c, "context": "API Endpoint"} for c in out]


def _images(root: Node, url: str) -> list[dict]:
    out = []
    for node in root.walk():
        src = node.attrs.get("src", "") if node.tag == "img" else ""
        if not src or src.startswith("data:") or not (full := _resolve(url, src)):
            continue
        size = {k: (int(m[0]) or None) if (m := re.match(r"\s*\d+", node.attrs.get(k, ""))) else None for k in ("width", "height")}
        around = node.closest({"figure", "p", "section", "div"})
        caption = next((n for n in around.walk() if n.tag == "figcaption"), None) if around is not None else None
        context = caption.text().strip() if caption is not None else None
        out.append({"src": full, "alt": node.attrs.get("alt", ""), "title": node.attrs.get("title") or None, **size, "context": context or _context(node)})
    return out


def extract_page(source: str | None, url: str, focus: str = "full", images: bool = False) -> dict:
    """All fields of a page but those that columns derive (language of code, type, framework, version)."""
    root = parse(source or "")
    pictures = _images(root, url)
    for node in NOISE.all(root):
        node.remove()
    nodes = list(root.walk())
    body = next((n for n in nodes if n.tag == "body"), root)
    parts = _container(root, body, focus)
    metas = _metas(root)
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    h1, lang, canonical, author, stamp = first("h1"), first("html"), None, None, None
    for n in nodes:
        if n.tag == "link" and n.attrs.get("rel") == "canonical":
            canonical = canonical or n.attrs.get("href")
        if n.attrs.get("rel") == "author":
            author = author or n.text().strip()
        if n.tag == "time" and n.attrs.get("datetime"):
            stamp = stamp or n.attrs["datetime"]
    title = (h1.text().strip() if h1 is not None else "") or "".join(n.text() for n in nodes if n.tag == "title").strip() or _meta(metas, "og:title") or "Untitled"
    headings = [{"level": int(n.tag[1]), "text": n.text().strip(), "id": n.attrs.get("id") or None} for p in parts for n in p.walk() if n.tag in HEADINGS]
    links, host = [], urlsplit(url).hostname
    for n in (n for p in parts for n in p.walk() if n.tag == "a"):
        href, text = n.attrs.get("href", ""), n.text().strip()
        if href and text and not href.startswith("#") and (full := _resolve(url, href)):
            links.append({"href": full, "text": text, "is_internal": urlsplit(full).hostname == host})
    inner = parts[0].html()
    return {
        "url": url,
        "title": title,
        "description": _meta(metas, "description") or _meta(metas, "og:description") or "",
        "markdown": resolve_links(convert(inner, images), url),
        "html": inner,
        "text": "".join(p.text() for p in parts),
        "code_blocks": _code_blocks(parts) + (_endpoints(parts) if focus == "api" else []),
        "headings": headings,
        "links": links,
        "metadata": {
            "author": _meta(metas, "author") or author,
            "published_date": _meta(metas, "article:published_time") or stamp,
            "language": lang.attrs.get("lang") if lang is not None else None,
            "og_image": _meta(metas, "og:image"),
            "canonical": canonical,
            "site_name": _meta(metas, "og:site_name"),
            "version": _meta(metas, "version") or _meta(metas, "doc-version"),
        },
        "images": pictures,
        "has_article": any(n.tag == "article" for n in nodes),
        "has_readme": any(n.attrs.get("id") == "readme" or "markdown-body" in n.attrs.get("class", "").split() for n in nodes),
        "body": body.text(),
    }


def _row(source: str | None, url: str, focus: str, images: bool) -> dict:
    """A page that cannot be read becomes a row with its error, instead of the end of the task."""
    try:
        return extract_page(source, url, focus, images)
    except Exception as e:  # noqa: BLE001
        return {"url": url, "error": f"{type(e).__name__}: {e}"}


def _batches(focus: str, images: bool, kind: pa.StructType, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few hundred pages at a time: trees are larger than their pages
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [_row(h, u or "", focus, images) for u, h in zip(part["__url"].to_pylist(), part["__html"].to_pylist())]
                fields = pa.array(rows, kind)
                yield pa.RecordBatch.from_arrays([*(part[c] for c in keep), *fields.flatten()], names=[*keep, *(f.name for f in kind)])

    return run


def extract(pages: DataFrame, focus: str = "full", images: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Structured pages of (url, html); only these two and the columns to keep cross to Python.

    A null url is an empty one, null html an empty page; repeated rows are all
    kept.  A page that fails has nulls and an ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    own = T.StructType.fromDDL(SCHEMA)
    kept = [pages.schema[c] for c in keep]
    # kept columns move to the front under names of their own
    names = [f"__k{i}" for i in range(len(kept))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, kept)] + own.fields)
    rows = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col("url").alias("__url"), F.col("html").alias("__html"))
    raw = rows.mapInArrow(_batches(focus, images, to_arrow_type(own), names), schema)
    code = F.transform("code_blocks", lambda b: b.withField("language", F.coalesce(b["language"], C.code_language(b["code"]))))
    meta = F.col("metadata").withField("type", C.content_type(F.col("url"), F.col("has_article"), F.col("has_readme")))
    meta = meta.withField("framework", C.framework(F.col("body"), F.col("url"))).withField("version", F.coalesce("metadata.version", C.version(F.col("body"))))
    out = raw.withColumns({"code_blocks": code, "text": C.clean(F.col("text")), "metadata": meta}).drop("has_article", "has_readme", "body")
    fields = [f.name for f in own.fields if f.name not in ("has_article", "has_readme", "body")]
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names)), *fields)
