"""Breadth-first crawls as a written table for each level, the cache of pages, and the packet of a crawl."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import columns as C
from loomtext.operators import documents, extract
from loomtext.runtime import scratch
from loomtext.sources import web

#: (url) to (url, html, status, error); ``web.fetching`` and ``web.stored`` make some.
Fetch = Callable[[DataFrame], DataFrame]
Hooks = Callable[[str, DataFrame], DataFrame]


@dataclass
class CrawlResult:
    """pages: extracted ones with depth and seq; errors: (url, error, status_code); diffs: as ``documents.diff``; stats: one row."""

    pages: DataFrame
    errors: DataFrame
    diffs: DataFrame
    stats: DataFrame


class PageCache:
    """Pages by URL in a folder of Parquet files that are only added to; the latest row of a URL counts, a null page takes it out."""

    def __init__(self, spark: SparkSession, path: str, ttl: int = 3600, max_size: int = 500) -> None:
        self.spark, self.path, self.ttl, self.max_size = spark, path.rstrip("/"), ttl, max_size

    def _files(self):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def rows(self) -> DataFrame | None:
        """The latest (url, ts, page) of each URL, without those taken out; None where nothing was ever stored."""
        files, path = self._files()
        if not files.exists(path):
            return None
        latest = Window.partitionBy("url_key").orderBy(F.desc("ts"), F.desc(F.col("page").isNull()))
        every = self.spark.read.parquet(self.path)
        return every.withColumn("__n", F.row_number().over(latest)).where("__n = 1 AND page IS NOT NULL").drop("__n")

    def get(self, urls: DataFrame, now: str) -> DataFrame | None:
        """Pages of the URLs that are not older than the time to live; ``now`` is a timestamp."""
        rows = self.rows()
        if rows is None:
            return None
        fresh = rows.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts") <= self.ttl)
        return urls.select("url").join(fresh.select("url", "page"), "url").select("page.*")

    def put(self, pages: DataFrame, now: str) -> None:
        """Store pages, then keep the ``max_size`` latest."""
        at = F.lit(now).cast("timestamp").alias("ts")
        pages.select(F.md5("url").alias("url_key"), "url", at, F.struct(*pages.columns).alias("page")).write.mode("append").parquet(self.path)
        self.trim()

    def trim(self) -> None:
        rows = self.rows()
        if rows is not None and rows.count() > self.max_size:
            kept = scratch(rows.orderBy(F.desc("ts"), "url").limit(self.max_size), "cache")
            kept.write.mode("overwrite").parquet(self.path)

    def has(self, url: str, now: str) -> bool:
        got = self.get(self.spark.createDataFrame([(url,)], "url string"), now)
        return got is not None and not got.isEmpty()

    def invalidate(self, url: str, now: str) -> None:
        rows = self.rows()
        if rows is not None:
            gone = rows.where(F.col("url") == url).withColumns({"page": F.lit(None).cast(rows.schema["page"].dataType), "ts": F.lit(now).cast("timestamp")})
            scratch(gone, "gone").write.mode("append").parquet(self.path)

    def clear(self) -> None:
        files, path = self._files()
        files.delete(path, True)

    def size(self) -> int:
        rows = self.rows()
        return 0 if rows is None else rows.count()


class Checkpoint:
    """State after each level of a crawl in a folder; ``load`` gives the last that was written whole."""

    NAMES = ("pages", "errors", "visited", "frontier")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, level: int, **tables: DataFrame) -> None:
        for name in self.NAMES:
            tables[name].write.mode("overwrite").parquet(f"{self.path}/{level}/{name}")
        self.spark.createDataFrame([(level,)], "level int").write.mode("append").parquet(f"{self.path}/levels")

    def load(self) -> tuple[int, dict[str, DataFrame]] | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/levels")
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return None
        level = self.spark.read.parquet(f"{self.path}/levels").agg(F.max("level")).first()[0]
        return level, {n: self.spark.read.parquet(f"{self.path}/{level}/{n}") for n in self.NAMES}


def seeds(spark: SparkSession, url: str, depth: int, max_pages: int, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), sitemaps: DataFrame | None = None, sitemap_url: str | None = None, robots_body: str | None = None) -> DataFrame:
    """(url, seq): entries of the named sitemap; else, for a crawl with depth, those of the site's own sitemap that match; else the URL.

    ``sitemaps`` is the table (url, xml) of what there is.
    """
    own = spark.createDataFrame([(url, 0)], "url string, seq long")
    if sitemaps is None or (sitemap_url is None and depth == 0):
        return own
    root = sitemap_url or web.discover_sitemap(spark, url, sitemaps, robots_body)
    if root is None:
        return own
    listed = web.read_sitemaps(sitemaps, root).select("url")
    if sitemap_url is None:
        listed = listed.where(C.url_matches(F.col("url"), list(include), list(exclude)))
    rows = listed.distinct().withColumn("seq", F.row_number().over(Window.orderBy("url")).cast("long")).where(F.col("seq") <= max_pages)  # a page limit's worth of rows
    rows = scratch(rows, "seeds")
    return own if sitemap_url is None and rows.isEmpty() else rows


def crawl(start: DataFrame, fetch: Fetch, depth: int = 0, max_pages: int = 50, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), focus: str = "full", images: bool = False, robots: DataFrame | None = None, agent: str = "*", cache: PageCache | None = None, now: str = "1970-01-01 00:00:00", checkpoint: Checkpoint | None = None, hooks: Hooks = lambda _, df: df) -> CrawlResult:
    """Fetch, extract and follow internal links from the seeds (url, seq) on.

    A level's pages are taken in the order of seq, an array that goes on with
    the place of the link in its page; of pages with equal text the first is kept,
    and its copies' links are not followed.  At most ``max_pages`` pages are
    kept in all.  URLs that robots rules deny, and fetches that fail, are errors.
    """
    spark = start.sparkSession
    frontier = scratch(start.groupBy("url").agg(F.array(F.min("seq").cast("long")).alias("seq")), "frontier")
    visited = pages = errors = None
    first, hits, misses = 0, 0, 0
    diffs: list[DataFrame] = []
    state = checkpoint.load() if checkpoint else None
    if state:
        first, (pages, errors, visited, frontier) = state[0] + 1, (state[1][n] for n in Checkpoint.NAMES)
    for level in range(first, depth + 1):
        kept = 0 if pages is None else pages.count()
        if kept >= max_pages or frontier.isEmpty():
            break
        todo = frontier
        denied = None
        if robots is not None:
            judged = scratch(web.allowed(todo, robots, agent), "judged")
            denied = judged.where("not allowed").select("url", F.lit("denied by robots.txt").alias("error"), F.lit(None).cast("int").alias("status_code"))
            todo = judged.where("allowed").drop("allowed")
        stored = cache.get(todo, now) if cache else None
        stored = None if stored is None else scratch(stored, "stored")
        missing = todo if stored is None else todo.join(stored.select("url"), "url", "left_anti")
        fetched = scratch(hooks("post-fetch", fetch(hooks("pre-fetch", missing.select("url")))), "fetched")
        failed = fetched.where("error is not null").select("url", "error", F.col("status").alias("status_code"))
        fresh = hooks("post-transform", hooks("pre-transform", hooks("post-extract", extract.extract(hooks("pre-extract", fetched.where("error is null")), focus, images))))
        own = scratch(fresh, "own")
        every = own.where("error is null")
        if cache:
            hit = 0 if stored is None else stored.count()
            hits, misses = hits + hit, misses + fetched.count()
            before = cache.rows()
            if before is not None:
                diffs.append(scratch(documents.diff(before.select("url", F.col("page.markdown").alias("markdown")), every.select("url", "markdown")).where("changed"), "diffs"))
        rows = every if stored is None else every.unionByName(stored.select(*every.columns))
        rows = rows.join(todo.select("url", "seq"), "url").withColumn("depth", F.lit(level))
        # of equal texts the first of the crawl
        marked = rows.withColumn("__fp", C.fingerprint(F.col("text")))
        if pages is not None:
            marked = marked.join(pages.select(C.fingerprint(F.col("text")).alias("__fp")).distinct(), "__fp", "left_anti")
        order = Window.partitionBy("__fp").orderBy("seq", "url")
        rows = marked.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__fp")
        rows = scratch(rows.orderBy("seq", "url").limit(max_pages - kept), "pages")
        if cache:
            cache.put(every.join(rows.select("url"), "url", "left_semi").select(*every.columns), now)
        pages = rows if pages is None else scratch(pages.unionByName(rows), "pages")
        new = failed.unionByName(own.where("error is not null").select("url", "error", F.lit(None).cast("int").alias("status_code")))
        new = new if denied is None else new.unionByName(denied)
        errors = scratch(new if errors is None else errors.unionByName(new), "errors")
        seen = todo.select("url") if denied is None else todo.select("url").unionByName(denied.select("url"))
        visited = scratch(seen if visited is None else visited.unionByName(seen), "visited")
        links = rows.select("seq", F.posexplode("links").alias("n", "l")).where("l.is_internal").select("seq", "n", F.col("l.href").alias("url"))
        links = links.where(C.url_matches(F.col("url"), list(include), list(exclude))).join(visited, "url", "left_anti")
        places = links.groupBy("url").agg(F.min(F.struct("seq", "n")).alias("at"))
        frontier = scratch(places.select("url", F.concat("at.seq", F.array(F.col("at.n").cast("long"))).alias("seq")), "frontier") if level < depth else frontier.limit(0)
        if checkpoint:
            checkpoint.save(level, pages=pages, errors=errors, visited=visited, frontier=frontier)
    if pages is None:
        raise ValueError("a crawl needs seeds")
    empty = spark.createDataFrame([], "url string, changed boolean, added array<string>, removed array<string>")
    found = empty
    for d in diffs:
        found = found.unionByName(d)
    stats = pages.agg(F.count(F.lit(1)).alias("pages_processed")).crossJoin(errors.agg(F.count(F.lit(1)).alias("errors"))).select("pages_processed", "errors", F.lit(hits).cast("long").alias("cache_hits"), F.lit(misses).cast("long").alias("cache_misses"))
    return CrawlResult(pages, errors, found, stats)


def packet(source: str, pages: DataFrame, chunks: DataFrame, at: str) -> DataFrame:
    """One row: (id, source, summary, total_tokens, page_count, content_type, framework, version, relationships) of a crawl.

    The summary is the first three sentences of all pages in order; type,
    framework and version are those of the first page.
    """
    first = pages.orderBy("depth", "seq", "url").limit(1).select(F.col("metadata.type").alias("content_type"), F.col("metadata.framework").alias("framework"), F.col("metadata.version").alias("version"))
    # three sentences need no more pages than the first that hold three
    order = Window.orderBy("depth", "seq", "url").rowsBetween(Window.unboundedPreceding, -1)
    lead = pages.select("depth", "seq", "url", "text").withColumn("__before", F.coalesce(F.sum(F.size(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]+"), F.lit(0)))).over(order), F.lit(0))).where("__before < 3")
    rows = F.array_sort(F.collect_list(F.struct("depth", "seq", "url", "text")))
    summary = lead.agg(C.first_sentences(F.array_join(F.transform(rows, lambda r: r["text"]), " ")).alias("summary"))
    tokens = chunks.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    count = pages.agg(F.count(F.lit(1)).alias("page_count"))
    edges = documents.edges(pages).agg(F.array_sort(F.collect_list(F.struct("src", "dst", "type"))).alias("relationships"))
    ident = F.substring(F.sha2(F.concat(F.lit(source), F.lit(at)), 256), 1, 16)
    one = summary.crossJoin(tokens).crossJoin(count).crossJoin(edges)
    first = one.sparkSession.range(1).select(F.lit(1).alias("__x")).join(first.withColumn("__x", F.lit(1)), "__x", "left").drop("__x")
    return one.crossJoin(first).select(ident.alias("id"), F.lit(source).alias("source"), "summary", "total_tokens", "page_count", F.coalesce("content_type", F.lit("unknown")).alias("content_type"), "framework", "version", "relationships")
