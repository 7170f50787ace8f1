"""Operators over collections of documents, chunks, links and snapshots, all native plans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.functions import chunking
from loomtext.functions import columns as C
from loomtext.runtime import scratch, small

#: Terms of queries that are sent to all tasks; more are shuffled.
QUERY_BYTES = 16 << 20


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each fingerprint in the key's order."""
    w = Window.partitionBy("__fp").orderBy(key)
    return docs.withColumn("__fp", C.fingerprint(F.col(text))).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__fp", "__n")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(duplicate, original) for each row but the first of its fingerprint."""
    w = Window.partitionBy("__fp").orderBy(key)
    rows = docs.select(F.col(key).alias("duplicate"), C.fingerprint(F.col(text)).alias("__fp"))
    return rows.withColumn("original", F.first("duplicate").over(Window.partitionBy("__fp").orderBy("duplicate"))).where("duplicate <> original").drop("__fp")


class Register:
    """Fingerprints of what has been taken in, in a folder of Parquet files that is only added to."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "fingerprint string, key string")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(folder)
        return self.spark.read.parquet(self.path) if there else empty

    def new(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The first row of each fingerprint that is not registered yet."""
        own = dedup(docs, key, text).withColumn("__fp", C.fingerprint(F.col(text)))
        return own.join(self._rows().select(F.col("fingerprint").alias("__fp")), "__fp", "left_anti").drop("__fp")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        rows = self.new(docs, key, text).select(C.fingerprint(F.col(text)).alias("fingerprint"), F.col(key).cast("string").alias("key"))
        scratch(rows, "register").write.mode("append").parquet(self.path)

    def size(self) -> int:
        return self._rows().count()

    def clear(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, n, len)."""
    rows = docs.select(key, C.tokens(F.col(text)).alias("__t")).select(key, F.size("__t").alias("len"), F.explode("__t").alias("term"))
    return rows.groupBy(key, "term", "len").agg(F.count(F.lit(1)).alias("n"))


def idf(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, df, idf), unsmoothed: the logarithm of documents over documents with the term."""
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    terms = docs.select(F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return terms.crossJoin(F.broadcast(total)).select("term", "df", F.ln(F.col("total") / F.col("df")).alias("idf"))


def tfidf(docs: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, weight); terms without an idf count in the length only."""
    return term_counts(docs, key, text).join(weights.select("term", "idf"), "term").select(key, "term", (F.col("n") / F.col("len") * F.col("idf")).alias("weight"))


class SearchIndex:
    """A TF-IDF index as written tables: texts are cut to terms once, when they are added.

    Weights follow from the counts of all that was added, so that documents
    added later weigh as if they had been there from the start.
    """

    def __init__(self, key: str = "doc_id", text: str = "text") -> None:
        self.key, self.text = key, text
        self.clear()

    def clear(self) -> None:
        self.counts: DataFrame | None = None
        self.documents = 0
        self._weighted: DataFrame | None = None

    def size(self) -> int:
        return self.documents

    def add(self, docs: DataFrame) -> SearchIndex:
        """Rows of new keys; a key must not come twice."""
        own = scratch(term_counts(docs, self.key, self.text), "terms")
        self.counts = own if self.counts is None else self.counts.unionByName(own)
        self.documents += docs.count()
        self._weighted = None
        return self

    def idf(self) -> DataFrame:
        return self.counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.ln(F.lit(self.documents) / F.col("df")))

    def _tables(self) -> DataFrame:
        if self._weighted is None:
            self._idf = scratch(self.idf(), "idf")
            weighted = self.counts.join(self._idf, "term").select(self.key, "term", (F.col("n") / F.col("len") * F.col("idf")).alias("weight"))
            self._weighted = scratch(weighted, "weights")
            self._norm = scratch(self._weighted.groupBy(self.key).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm")), "norms")
        return self._weighted

    def search(self, queries: DataFrame, top_k: int = 5, query_key: str = "query_id", text: str = "text") -> DataFrame:
        """(query, key, score, rank): cosine of sparse vectors; scores above 0, ties by key."""
        key = self.key
        if self.counts is None:
            kinds = queries.select(query_key).schema
            return queries.sparkSession.createDataFrame([], f"{query_key} {kinds[0].dataType.simpleString()}, {key} string, score double, rank int")
        index = self._tables()
        asked = scratch(term_counts(queries, query_key, text).join(self._idf, "term").select(query_key, "term", (F.col("n") / F.col("len") * F.col("idf")).alias("q")), "asked")
        qnorm = asked.groupBy(query_key).agg(F.sqrt(F.sum(F.col("q") ** 2)).alias("qnorm"))
        # a term's list of documents is as long as it is; the queries' side is small enough to go to it, or both are shuffled
        dots = index.join(small(asked, QUERY_BYTES), "term").groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("q")).alias("dot"))
        scored = dots.join(self._norm, key).join(qnorm, query_key).select(query_key, key, F.round(F.try_divide("dot", F.col("norm") * F.col("qnorm")), 6).alias("score")).where("score > 0")
        return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))).where(F.col("rank") <= top_k)


def search(docs: DataFrame, queries: DataFrame, top_k: int = 5, key: str = "doc_id", query_key: str = "query_id", text: str = "text") -> DataFrame:
    """The best documents of each query, from an index built for the purpose."""
    return SearchIndex(key, text).add(docs).search(queries, top_k, query_key)


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, type): links to other pages of the set, repeats kept."""
    links = pages.select(F.col("url").alias("src"), F.explode("links.href").alias("dst"))
    return links.join(pages.select(F.col("url").alias("dst")).distinct(), "dst", "left_semi").where("src <> dst").select("src", "dst", F.lit("links-to").alias("type"))


def crawl_levels(seeds: DataFrame, links: DataFrame, depth: int, include: list[str] | None = None, exclude: list[str] | None = None, max_pages: int | None = None) -> DataFrame:
    """(url, depth): breadth first from the seeds; a written table for each level instead of a growing plan."""
    visited = scratch(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "visited")
    frontier = visited
    for level in range(1, depth + 1):
        found = frontier.join(links, frontier["url"] == links["src"]).select(F.col("dst").alias("url")).distinct()
        found = found.where(C.url_matches(F.col("url"), include or [], exclude or [])).join(visited, "url", "left_anti")
        frontier = scratch(found.withColumn("depth", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)


def cached(requests: DataFrame, snapshots: DataFrame, now: Column, ttl: int = 3600) -> DataFrame:
    """Requests with whether a snapshot not older than the time to live exists."""
    fresh = snapshots.where(F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl).groupBy("url_key").agg(F.max("ts").alias("cached_at"))
    return requests.withColumn("url_key", F.md5("url")).join(fresh, "url_key", "left").withColumn("hit", F.col("cached_at").isNotNull())


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(url, changed, added, removed) from (url, markdown) then and now: headings in order, repeats kept."""
    heads = lambda c: F.regexp_extract_all(c, F.lit(r"(?md)^#{1,6}[ \t]+(.+)$"), F.lit(1))
    joined = after.select("url", F.col("markdown").alias("new")).join(before.select("url", F.col("markdown").alias("old")), "url")
    rows = joined.withColumns({"o": heads(F.col("old")), "n": heads(F.col("new"))})
    changed = F.sha2("old", 256) != F.sha2("new", 256)
    return rows.select("url", changed.alias("changed"), F.filter("n", lambda h: ~F.array_contains("o", h)).alias("added"), F.filter("o", lambda h: ~F.array_contains("n", h)).alias("removed"))


def _chunk_batches(strategy: str, limit: int, overlap: int, keep_code: bool, tokenizer: str | None):
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = state.setdefault("count", token_counter(tokenizer))
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for url, title, text, heads in zip(*(batch[c].to_pylist() for c in ("url", "title", "markdown", "headings"))):
                chunks = chunking.split(text or "", strategy, limit, overlap, keep_code, count)
                places = chunking.heading_places(text or "", [(h["level"], h["text"]) for h in heads or ()])
                for i, c in enumerate(chunks):
                    for col, v in zip(cols, (url, title, c, count(c), i, len(chunks), chunking.path_at(c, text, places))):
                        col.append(v)
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["source_url", "title", "content", "tokens", "chunk_index", "total_chunks", "heading_path"])

    return run


def token_counter(vocabulary: str | None):
    """Counts by a rank file where one is named, else by the estimate of four characters a token."""
    if vocabulary is None:
        return chunking.estimate
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(coder.encode_ordinary(text))


def chunk(pages: DataFrame, strategy: str = "semantic", limit: int = 1500, overlap: int = 100, keep_code: bool = True, tokenizer: str | None = None) -> DataFrame:
    """One row a chunk of (url, title, markdown, headings)."""
    raw = pages.select("url", "title", "markdown", "headings").mapInArrow(_chunk_batches(strategy, limit, overlap, keep_code, tokenizer), "source_url string, title string, content string, tokens int, chunk_index int, total_chunks int, heading_path array<string>")
    fence = "`" * 3
    return raw.select(
        C.chunk_id(F.col("source_url"), F.col("chunk_index"), F.col("content")).alias("id"),
        "*",
        F.col("content").rlike(f"(?s){fence}.*?{fence}").alias("has_code"),
        F.nullif(F.regexp_extract("content", fence + r"(\w+)", 1), F.lit("")).alias("language"),
        F.lit(tokenizer or "estimate").alias("tokenizer"),
    )
