"""Sources: sitemaps, robots rules, repository and PDF texts, local files, and a pluggable fetcher."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import columns as C
from loomtext.runtime import scratch

#: (url) -> (body, status); the network is a matter of who supplies it.
Fetcher = Callable[[str], tuple[str, int]]


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    """Trimmed, the entities of XML decoded."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(text)


def sitemap_entries(xml: Column) -> Column:
    """Array of (url, lastmod, changefreq, priority) of a URL set; malformed XML gives none."""
    entry = F.regexp_extract_all(xml, F.lit(r"(?s)<url\b[^>]*>(.*?)</url>"), F.lit(1))
    field = lambda x, name: F.nullif(_plain(F.regexp_extract(x, rf"(?s)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1)), F.lit(""))
    rows = F.transform(entry, lambda x: F.struct(field(x, "loc").alias("url"), field(x, "lastmod").alias("lastmod"), field(x, "changefreq").alias("changefreq"), field(x, "priority").try_cast("double").alias("priority")))
    return F.filter(rows, lambda r: r["url"].isNotNull())


def sitemap_children(xml: Column) -> Column:
    """Locations of the sitemaps that an index lists."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?s)<sitemap\b[^>]*>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1)), _plain)


def read_sitemaps(documents: DataFrame, root: str) -> DataFrame:
    """Entries of a sitemap (url, xml) and of all that it lists, at any depth, each read once."""
    level = documents.where(F.col("url") == root)
    done, out = level.select("url"), None
    while True:
        rows = level.select(F.explode(sitemap_entries(F.col("xml"))).alias("e")).select("e.*")
        out = rows if out is None else out.unionByName(rows)
        next_ = scratch(level.select(F.explode(sitemap_children(F.col("xml"))).alias("url")).distinct().join(done, "url", "left_anti"), "sitemaps")
        if next_.isEmpty():
            return out
        done = done.union(next_)
        level = scratch(documents.join(next_, "url"), "level")


def discover_sitemap(spark: SparkSession, base: str, known: DataFrame, robots_body: str | None = None) -> str | None:
    """The sitemap that robots.txt names, else the first of the common places that is in the table (url, ...)."""
    named = re.search(r"(?im)^Sitemap:\s*(.+)$", robots_body or "")
    if named:
        return named[1].strip()
    for path in ("/sitemap.xml", "/sitemap_index.xml"):
        if not known.where(F.col("url") == base.rstrip("/") + path).isEmpty():
            return base.rstrip("/") + path
    return None


def robots_rules(robots: DataFrame) -> DataFrame:
    """(origin, agent, allow, path) of (origin, body).

    Agents named in lines that follow each other share the rules after them; a
    group without rules allows all; lines before any agent are of no one.
    """
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("n", "line"))
    parts = lines.select("origin", "n", F.lower(F.trim(F.regexp_extract("line", r"^\s*([A-Za-z-]+)\s*:", 1))).alias("field"), F.trim(F.regexp_extract("line", r":\s*([^#]*)", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    order = Window.partitionBy("origin").orderBy("n")
    begins = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = parts.withColumn("group", F.sum(begins.cast("int")).over(order))
    agents = grouped.where("field = 'user-agent'").select("origin", "group", F.regexp_extract(F.lower("value"), "^[^/]*", 0).alias("agent"))
    rules = grouped.where("field <> 'user-agent' and value <> ''").select("origin", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    # the empty rule keeps a group that has no other
    none = agents.select("origin", "agent", F.lit(True).alias("allow"), F.lit("").alias("path"))
    return agents.join(rules, ["origin", "group"]).select("origin", "agent", "allow", "path").unionByName(none).distinct()


def _rule_pattern(path: Column) -> Column:
    """A rule's path as a regular expression: * is any text, $ at the end the end."""
    quoted = F.regexp_replace(path, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.replace(quoted, F.lit("*"), F.lit(".*")), r"\\\$$", r"\$"))


def allowed(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """URLs with whether the longest rule that fits their path allows them, of equal ones an allowing one; no rule allows.

    The rules are those of the agent's own groups on that origin, and those of
    ``*`` only where it has none.
    """
    split = urls.select("url").distinct().withColumns({"origin": F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1), "path": F.regexp_extract("url", "^[a-z]+://[^/?#]+(.*)$", 1)})
    split = split.withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    mine = rules.where(F.col("agent") == agent.lower().split("/")[0])
    other = rules.where(F.col("agent") == "*").join(mine.select("origin").distinct(), "origin", "left_anti")
    own = mine.unionByName(other).select(F.col("origin").alias("o"), "allow", F.col("path").alias("rule"), _rule_pattern(F.col("path")).alias("pattern"))
    fits = split.join(own, F.col("origin") == F.col("o")).where(F.rlike("path", F.col("pattern")))
    best = fits.groupBy("url").agg(F.max_by("allow", F.struct(F.length("rule"), F.col("allow").cast("int"))).alias("rule_allows"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("rule_allows", F.lit(True))).drop("rule_allows")


def sitemap_of_robots(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?im)^Sitemap:\s*(.+)$", 1)), F.lit(""))


def pdf_headings(text: Column) -> Column:
    """Numbered or capital lines of at most 100 characters that no full stop ends."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & (F.length(x) <= 100) & ~x.endswith(".") & (x.rlike(r"^\d+\.\s+[A-Z]") | x.rlike(r"^[A-Z][A-Z\s]{3,}$")))
    return F.transform(kept, lambda x: F.struct(F.when(x.rlike(r"^\d+\.\d+"), 2).otherwise(1).alias("level"), x.alias("text"), F.lit(None).cast("string").alias("id")))


def pdf_markdown(title: Column, author: Column, pages: Column, text: Column) -> Column:
    by = F.when(author.isNotNull() & (author != ""), F.concat(F.lit("> Author: "), author, F.lit("\n\n"))).otherwise("")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), by, F.lit("> "), pages.cast("string"), F.lit(" pages\n\n"), text)


def markdown_headings(md: Column) -> Column:
    lines = F.regexp_extract_all(md, F.lit(r"(?md)^(#{1,6}[ \t]+.+)$"), F.lit(1))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("text"), F.lit(None).cast("string").alias("id")))


def fenced_code(md: Column) -> Column:
    pattern = "(?s)" + "`" * 3 + r"(\w*)\n(.*?)" + "`" * 3
    found = lambda i: F.regexp_extract_all(md, F.lit(pattern), F.lit(i))
    return F.zip_with(found(1), found(2), lambda lang, code: F.struct(F.when(lang == "", "text").otherwise(lang).alias("language"), F.regexp_replace(code, r"^\s+|\s+$", "").alias("code")))


def markdown_links(md: Column, base: Column) -> Column:
    """(href, text, is_internal) of inline links; one that isn't absolute is internal and stands below the base."""
    pattern = F.lit(r"\[([^\]]+)\]\(([^)]+)\)")
    found = lambda i: F.regexp_extract_all(md, pattern, F.lit(i))
    full = lambda h: F.when(h.startswith("http"), h).otherwise(F.concat(base, h))
    return F.zip_with(found(2), found(1), lambda h, t: F.struct(full(h).alias("href"), t.alias("text"), (~h.startswith("http")).alias("is_internal")))


def markdown_text(md: Column) -> Column:
    """The words of Markdown without its marks."""
    return F.trim(F.regexp_replace(F.regexp_replace(md, r"[#*`\[\]()>-]", " "), r"(?U)\s+", " "))


_HOST = "https://raw.githubusercontent.com/"


def readme_candidates(repos: DataFrame) -> DataFrame:
    """(repo_url, url, n): where a repository's README may be, in the order to try."""
    p = C.repo_parts(F.col("repo_url"))
    at = lambda ref, name: F.concat(F.lit(_HOST), p["owner"], F.lit("/"), p["repo"], F.lit("/"), ref, F.lit(f"/{name}"))
    ref = F.coalesce(p["branch"], F.lit("main"))
    places = F.array(*(at(ref, n) for n in ("README.md", "readme.md", "Readme.md")), at(F.lit("master"), "README.md"))
    return repos.where(C.is_repo(F.col("repo_url"))).select("repo_url", F.posexplode(places).alias("n", "url"))


def readmes(repos: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of the repositories' READMEs, from (url, body) of what was fetched or is stored; one without any is left out."""
    found = readme_candidates(repos).join(files.where("body is not null"), "url")
    best = found.groupBy("repo_url").agg(F.min_by("body", "n").alias("markdown"))
    p = C.repo_parts(F.col("repo_url"))
    base = F.concat(F.lit("https://github.com/"), p["owner"], F.lit("/"), p["repo"], F.lit("/blob/"), F.coalesce(p["branch"], F.lit("main")), F.lit("/"))
    md = F.col("markdown")
    return best.select(F.col("repo_url").alias("url"), F.concat_ws("/", p["owner"], p["repo"]).alias("title"), "markdown", markdown_text(md).alias("text"), fenced_code(md).alias("code_blocks"), markdown_headings(md).alias("headings"), markdown_links(md, base).alias("links"), p["owner"].alias("author"), F.lit("readme").alias("type"))


def docs_folder(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Pages of a folder's Markdown files, from (name, kind, download_url, html_url) and (url, body)."""
    md = F.col("body")
    own = listing.where((F.col("kind") == "file") & F.col("name").endswith(".md")).join(files, F.col("download_url") == files["url"]).where("body is not null")
    title = F.coalesce(F.get(markdown_headings(md), F.lit(0))["text"], F.replace("name", F.lit(".md"), F.lit("")))
    return own.select(F.col("html_url").alias("url"), title.alias("title"), md.alias("markdown"), markdown_text(md).alias("text"), fenced_code(md).alias("code_blocks"), markdown_headings(md).alias("headings"), F.lit("documentation").alias("type"))


_STRING = re.compile(rb"\((?:[^()\\]|\\.)*\)")
_SHOWN = re.compile(rb"(\((?:[^()\\]|\\.)*\))\s*(?:Tj|'|\")|\[((?:[^\]\\(]|\((?:[^()\\]|\\.)*\))*)\]\s*TJ|(T\*|T[dD]|TL|ET)\b", re.S)


def _pdf_string(data: bytes) -> str:
    codes = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else codes.get(m[1], m[1]), data[1:-1], flags=re.S)
    return plain.decode("utf-16") if plain[:2] in (b"\xfe\xff", b"\xff\xfe") else plain.decode("latin-1")


def pdf_document(data: bytes) -> dict:
    """title, author, pages and text of a PDF whose text is in strings of one-byte codes, plain or deflated; text in other codes is missed."""
    import zlib

    text = []
    for m in re.finditer(rb"<<((?:(?!endobj).)*?)>>\s*stream\r?\n(.*?)\r?\n?endstream", data, re.S):
        body = m[2]
        if b"/FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        for shown in _SHOWN.finditer(body):
            if shown[1]:
                text.append(_pdf_string(shown[1]))
            elif shown[2] is not None:
                text.append("".join(_pdf_string(x) for x in _STRING.findall(shown[2])))
            elif text and text[-1] != "\n":
                text.append("\n")
    info = {k: _pdf_string(v) for k, v in re.findall(rb"/(Title|Author)\s*(\((?:[^()\\]|\\.)*\))", data)}
    return {"title": info.get(b"Title"), "author": info.get(b"Author"), "pages": len(re.findall(rb"/Type\s*/Page\b", data)), "text": "".join(text).strip("\n")}


def pdf_pages(files: DataFrame) -> DataFrame:
    """Pages of PDF files (url, content): one that can't be read has an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, data in zip(batch["url"].to_pylist(), batch["content"].to_pylist()):
                try:
                    row = pdf_document(data or b"") | {"error": None if (data or b"").startswith(b"%PDF") else "not a PDF"}
                except Exception as e:  # noqa: BLE001
                    row = {"title": None, "author": None, "pages": 0, "text": None, "error": str(e)}
                yield pa.RecordBatch.from_pylist([{"url": url} | row], pa.schema([("url", pa.string()), ("title", pa.string()), ("author", pa.string()), ("pages", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    rows = files.select("url", "content").mapInArrow(run, "url string, title string, author string, pages int, text string, error string")
    name = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"(?i)\.pdf$", "")
    titled = rows.withColumn("title", F.coalesce("title", F.nullif(name, F.lit("")), F.lit("Untitled PDF")))
    about = F.concat(F.lit("PDF document: "), "title", F.lit(" ("), F.col("pages").cast("string"), F.lit(" pages)"))
    return titled.select("url", "title", about.alias("description"), pdf_markdown(F.col("title"), F.col("author"), F.col("pages"), F.coalesce("text", F.lit(""))).alias("markdown"), "text", pdf_headings(F.coalesce("text", F.lit(""))).alias("headings"), "author", F.lit("documentation").alias("type"), F.array(F.lit("pdf")).alias("tags"), "error")


def image_markdown(images: Column) -> Column:
    """References to the images that have a text or a context, a paragraph each."""
    kept = F.filter(images, lambda i: (F.coalesce(i["alt"], F.lit("")) != "") | (F.coalesce(i["context"], F.lit("")) != ""))
    title = lambda i: F.when(i["title"].isNotNull(), F.concat(F.lit(' "'), i["title"], F.lit('"'))).otherwise("")
    return F.array_join(F.transform(kept, lambda i: F.concat(F.lit("!["), F.coalesce(F.nullif(i["alt"], F.lit("")), i["context"]), F.lit("]("), i["src"], title(i), F.lit(")"))), "\n\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, body) of local or shared text files, one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("body"))


def fetch(urls: DataFrame, fetcher: Fetcher, retries: int = 3, statuses: tuple[int, ...] = (429, 500, 502, 503, 504), backoff_ms: int = 1000, wait: Callable[[float], None] | None = None) -> DataFrame:
    """(url, html, status, error): each URL by a fetcher that the caller supplies, with exponential waits between tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        pause = wait or time.sleep
        for batch in batches:
            rows = []
            for url in batch["url"].to_pylist():
                body, status, error = None, None, None
                for attempt in range(retries + 1):
                    try:
                        body, status = fetcher(url)
                        error = f"HTTP {status}" if status >= 400 else None
                        if status not in statuses:
                            break
                    except OSError as e:
                        error = str(e)
                    if attempt < retries:
                        pause(backoff_ms * 2**attempt / 1000)
                rows.append((url, None if error else body, status, error))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string()))], names=["url", "html", "status", "error"])

    return urls.select("url").mapInArrow(run, "url string, html string, status int, error string")


def fetching(fetcher: Fetcher, retries: int = 3, delay_ms: int = 0, partitions: int | None = None, wait: Callable[[float], None] | None = None, **options: object) -> Callable[[DataFrame], DataFrame]:
    """A crawl's way to fetch: hosts go to ``partitions`` tasks, which ask one URL after the other, ``delay_ms`` apart."""

    def run(urls: DataFrame) -> DataFrame:
        host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
        placed = urls.repartition(partitions, host) if partitions else urls.repartition(host)

        def paced(url: str) -> tuple[str, int]:
            import time

            out = fetcher(url)
            if delay_ms:
                (wait or time.sleep)(delay_ms / 1000)
            return out

        return fetch(placed, paced, retries, wait=wait, **options)

    return run


def stored(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A crawl's way to fetch from a table (url, html): a URL that isn't there is not found."""
    once = pages.groupBy("url").agg(F.first("html").alias("html"), F.lit(200).alias("status"))

    def run(urls: DataFrame) -> DataFrame:
        rows = urls.join(once, "url", "left")
        return rows.select("url", "html", F.coalesce("status", F.lit(404)).alias("status"), F.when(F.col("status").isNull(), F.lit("HTTP 404")).alias("error"))

    return run


def valid_url(url: Column) -> Column:
    """Whether it is an absolute http or https URL with a host."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(url, F.lit("HOST")).isNotNull(), F.lit(False))
