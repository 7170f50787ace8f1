"""Facade: a session's sources, operators and exports behind one object."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import crawl as crawling
from loomtext.operators import documents, extract, output
from loomtext.runtime import scratch
from loomtext.sources import web

Hook = Callable[[DataFrame], DataFrame]
PHASES = tuple(f"{when}-{what}" for what in ("fetch", "extract", "transform", "chunk") for when in ("pre", "post"))


@dataclass(frozen=True)
class ChunkOptions:
    strategy: str = "semantic"
    limit: int = 1500
    overlap: int = 100
    keep_code: bool = True
    tokenizer: str | None = None


@dataclass(frozen=True)
class CrawlOptions:
    depth: int = 3
    max_pages: int = 50
    timeout: int = 30_000
    delay: int = 500
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, low, high in (("depth", 0, 10), ("max_pages", 1, 10_000), ("timeout", 1000, 120_000), ("delay", 0, 60_000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}")


@dataclass
class Crawled:
    """What a crawl gives: its pages, errors, diffs and stats, their chunks, links between them, and the packet."""

    source: str
    pages: DataFrame
    errors: DataFrame
    diffs: DataFrame
    stats: DataFrame
    chunks: DataFrame
    relationships: DataFrame
    packet: DataFrame


@dataclass
class Engine:
    """Extraction and chunking are plans that run with their action; a crawl runs level by level."""

    spark: SparkSession
    chunking: ChunkOptions = field(default_factory=ChunkOptions)
    hooks: dict[str, list[Hook]] = field(default_factory=dict)
    templates: output.Templates = field(default_factory=output.Templates)
    subscribers: list[dict] = field(default_factory=list)

    def on(self, phase: str, hook: Hook) -> None:
        if phase not in PHASES:
            raise ValueError(f"no phase {phase}")
        self.hooks.setdefault(phase, []).append(hook)

    def _run(self, phase: str, df: DataFrame) -> DataFrame:
        for hook in self.hooks.get(phase, ()):
            df = hook(df) or df
        return df

    def fetch(self, urls: DataFrame, fetch: crawling.Fetch) -> DataFrame:
        """(url, html, status, error) with the hooks around fetching."""
        return self._run("post-fetch", fetch(self._run("pre-fetch", urls)))

    def extract(self, pages: DataFrame, focus: str = "full", images: bool = False) -> DataFrame:
        """Extraction makes the Markdown too, so its hooks stand within those of the transformation."""
        found = self._run("post-extract", extract.extract(self._run("pre-extract", pages), focus, images))
        return self._run("post-transform", self._run("pre-transform", found))

    def chunks(self, pages: DataFrame) -> DataFrame:
        o = self.chunking
        return self._run("post-chunk", documents.chunk(self._run("pre-chunk", pages), o.strategy, o.limit, o.overlap, o.keep_code, o.tokenizer))

    def crawl(self, url: str, fetch: crawling.Fetch, options: CrawlOptions = CrawlOptions(), focus: str = "full", images: bool = False, sitemaps: DataFrame | None = None, sitemap_url: str | None = None, robots: DataFrame | None = None, cache: crawling.PageCache | None = None, checkpoint: crawling.Checkpoint | None = None, now: str = "1970-01-01 00:00:00", agent: str = "*") -> Crawled:
        """Seeds, pages by levels, chunks and packet; ``robots`` is (origin, body), ``sitemaps`` (url, xml)."""
        if not self.spark.range(1).select(web.valid_url(F.lit(url))).first()[0]:
            raise ValueError(f"not an http or https URL: {url}")
        o = options
        rules = None if robots is None else web.robots_rules(robots)
        start = crawling.seeds(self.spark, url, o.depth, o.max_pages, o.include, o.exclude, sitemaps, sitemap_url)
        got = crawling.crawl(start, fetch, o.depth, o.max_pages, o.include, o.exclude, focus, images, rules, agent, cache, now, checkpoint, self._run)
        chunks = scratch(self.chunks(got.pages).join(got.pages.select(F.col("url").alias("source_url"), "depth", "seq"), "source_url"), "chunks")
        return Crawled(url, got.pages, got.errors, got.diffs, got.stats, chunks, documents.edges(got.pages), crawling.packet(url, got.pages, chunks, now))

    def markdown(self, crawled: Crawled) -> str:
        """The Markdown of all pages in order as one text."""
        order = F.array_sort(F.collect_list(F.struct("depth", "seq", "url", "markdown")))
        return crawled.pages.agg(F.array_join(F.transform(order, lambda r: r["markdown"]), output.SEPARATOR)).first()[0]

    def context(self, crawled: Crawled, budget: int = 8000) -> str:
        """The packet for a model: header, then chunks in order while the budget lasts."""
        rows = crawled.chunks.select(F.lit(crawled.source).alias("source"), F.struct("depth", "seq", "source_url", "chunk_index").alias("seq"), "heading_path", "content", "tokens")
        return output.context_text(crawled.packet, rows, budget).first()["context"]

    def search(self, chunks: DataFrame, queries: DataFrame, top_k: int = 5) -> DataFrame:
        return documents.search(chunks, queries, top_k, "id", "query_id", "content") if "text" not in chunks.columns else documents.search(chunks, queries, top_k)

    def export(self, chunks: DataFrame, target: str, collection: str | None = None) -> DataFrame:
        return output.exported(chunks, target, collection)

    def readmes(self, urls: DataFrame, fetch: crawling.Fetch) -> DataFrame:
        """Pages of repositories (repo_url); all places where a README may be are asked for."""
        files = self.fetch(web.readme_candidates(urls).select("url").distinct(), fetch)
        return web.readmes(urls, files.select("url", F.col("html").alias("body")))

    def pdfs(self, path: str) -> DataFrame:
        """Pages of the PDF files in a folder that all executors can read."""
        return web.pdf_pages(self.spark.read.format("binaryFile").load(path).select(F.col("path").alias("url"), "content"))

    def subscribe(self, url: str, events: tuple[str, ...], secret: str | None = None) -> None:
        self.subscribers.append({"url": url, "events": events, "secret": secret})

    def unsubscribe(self, url: str) -> None:
        self.subscribers = [s for s in self.subscribers if s["url"] != url]

    def notices(self, crawled: Crawled, at: str) -> list[tuple[str, str, dict[str, str]]]:
        """(URL, body, headers) of the notices that the crawl gives rise to, for the caller to send."""
        one, packet = crawled.stats.first(), crawled.packet.first()
        events = [("crawl.complete", {"source": crawled.source, "pagesProcessed": one["pages_processed"], "totalTokens": packet["total_tokens"], "errors": one["errors"]})]
        changed = crawled.diffs.orderBy("url").collect()  # of one crawl, at most max_pages
        if changed:
            events.append(("content.changed", {"changedPages": len(changed), "diffs": [{"url": d["url"], "addedSections": d["added"], "removedSections": d["removed"]} for d in changed]}))
        events += [("crawl.error", {"url": e["url"], "error": e["error"]}) for e in crawled.errors.orderBy("url").toLocalIterator()]
        return [(s["url"], *output.notice(event, data, at, s["secret"])) for event, data in events for s in self.subscribers if event in s["events"]]
