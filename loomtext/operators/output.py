"""Texts and records for consumers: templates, context for a model, vector-store exports, notices."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import columns as C

TEMPLATES = {
    "default": "# {{title}}\n\nSource: {{url}}\n\n{{markdown}}",
    "llm": '<context source="{{url}}" tokens="{{tokens}}">\n{{markdown}}\n</context>',
    "xml-tags": "<document>\n<title>{{title}}</title>\n<source>{{url}}</source>\n<content>\n{{markdown}}\n</content>\n</document>",
    "summary": "## {{title}}\n\n> {{summary}}\n\n**Source:** {{url}} | **Tokens:** {{tokens}}\n\n---\n\n{{markdown}}",
    "minimal": "{{markdown}}",
}
SEPARATOR = "\n\n---\n\n"


class Templates:
    """The built-in templates and those that are registered, by name."""

    def __init__(self) -> None:
        self.texts = dict(TEMPLATES)

    def register(self, name: str, text: str) -> None:
        self.texts[name] = text

    def names(self) -> list[str]:
        return list(self.texts)

    def fill(self, name: str, fields: dict[str, Column]) -> Column:
        """The template's text with each placeholder replaced once, literally; a null field is empty."""
        if name not in self.texts:
            raise ValueError(f"no template {name}; there are {', '.join(self.names())}")
        parts = re.split(r"\{\{(\w+)\}\}", self.texts[name])
        pieces = [F.coalesce(fields[p].cast("string"), F.lit("")) if i % 2 and p in fields else F.lit(f"{{{{{p}}}}}" if i % 2 else p) for i, p in enumerate(parts)]
        return F.concat(*pieces)

    def pages(self, pages: DataFrame, name: str = "default", out: str = "rendered") -> DataFrame:
        """Each page of (title, url, markdown, description) as a text."""
        fields = {"title": F.col("title"), "url": F.col("url"), "markdown": F.col("markdown"), "summary": F.col("description"), "tokens": C.estimated_tokens(F.col("markdown"))}
        return pages.withColumn(out, self.fill(name, fields))

    def joined_pages(self, pages: DataFrame, group: str, order: str, name: str = "default", separator: str = SEPARATOR) -> DataFrame:
        """(group, rendered): the pages of each group as one text, which is as long as they are together."""
        rows = self.pages(pages, name, "__text")
        return rows.groupBy(group).agg(_in_order("__text", order, separator).alias("rendered"))

    def contexts(self, packets: DataFrame, chunks: DataFrame, name: str = "default") -> DataFrame:
        """(source, rendered) of packets (source, summary, total_tokens) and the chunks (source, seq, content) that belong to them."""
        texts = chunks.groupBy("source").agg(_in_order("content", "seq", "\n\n").alias("__text"), F.count(F.lit(1)).alias("__n"))
        fields = {"title": F.col("source"), "url": F.col("source"), "markdown": F.col("__text"), "summary": F.col("summary"), "tokens": F.col("total_tokens"), "chunks": F.coalesce("__n", F.lit(0))}
        return packets.join(texts, "source", "left").select("source", self.fill(name, fields).alias("rendered"))


def _in_order(text: str, order: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def within_budget(chunks: DataFrame, budget: int, group: str, order: str, tokens: str = "tokens", header: Column | None = None) -> DataFrame:
    """The first chunks of each group, up to the one with which the running sum and the header's tokens would exceed the budget."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chunks.withColumn("used", (F.sum(tokens).over(w) + (F.lit(0) if header is None else header)).cast("long")).where(F.col("used") <= budget)


def context_text(packets: DataFrame, chunks: DataFrame, budget: int = 8000) -> DataFrame:
    """(source, context): a header, then chunks under the titles above them while the budget of tokens lasts.

    Packets are (source, summary, page_count, total_tokens, content_type),
    chunks (source, seq, heading_path, content, tokens).
    """
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    said = F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("> "), "summary", F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit("# "), "source", F.lit("\n\n"), said, F.lit("> "), number("page_count"), F.lit(" pages | "), number("total_tokens"), F.lit(" tokens | "), F.coalesce("content_type", F.lit("unknown")), F.lit("\n\n"))
    heads = packets.select("source", head.alias("__head"))
    kept = within_budget(chunks.join(heads, "source"), budget, "source", "seq", "tokens", F.ceil(F.length("__head") / 4))
    title = F.when(F.size("heading_path") > 0, F.concat(F.lit("## "), F.array_join("heading_path", " > "), F.lit("\n\n"))).otherwise("")
    body = kept.withColumn("__text", F.concat(title, "content", F.lit("\n\n"))).groupBy("source").agg(_in_order("__text", "seq", "").alias("__body"))
    return heads.join(body, "source", "left").select("source", F.rtrim(F.regexp_replace(F.concat("__head", F.coalesce("__body", F.lit(""))), r"\s+$", "")).alias("context"))


TARGETS = ("pinecone", "chroma", "weaviate", "qdrant", "json")


def record(target: str, collection: str | None = None) -> Column:
    """A vector store's record of a chunk."""
    meta = [F.col("content"), F.col("source_url").alias("source"), F.col("title"), F.concat_ws(" > ", "heading_path").alias("headingPath"), F.col("chunk_index").alias("chunkIndex"), F.col("total_chunks").alias("totalChunks"), F.col("has_code").alias("hasCode"), F.coalesce("language", F.lit("")).alias("language"), F.col("tokens")]
    if target == "pinecone":
        extra = [F.lit(collection).alias("namespace")] if collection else []
        return F.struct("id", F.struct(*meta, *extra).alias("metadata"))
    if target == "chroma":
        return F.struct("id", F.col("content").alias("document"), F.struct(*meta[1:5], *meta[6:]).alias("metadata"))
    if target == "weaviate":
        return F.struct(F.lit(collection or "WebContent").alias("class"), F.struct(*meta, F.col("id").alias("chunkId")).alias("properties"))
    if target == "qdrant":
        return F.struct("id", F.struct(*meta).alias("payload"))
    if target == "json":
        own = F.struct(F.col("source_url").alias("sourceUrl"), "title", F.col("heading_path").alias("headingPath"), F.col("chunk_index").alias("chunkIndex"), F.col("total_chunks").alias("totalChunks"), F.col("has_code").alias("hasCode"), "language")
        return F.struct("id", "content", "tokens", own.alias("metadata"))
    raise ValueError(f"no export format {target}; there are {', '.join(TARGETS)}")


def exported(chunks: DataFrame, target: str, collection: str | None = None) -> DataFrame:
    """(id, record): the records as JSON, a row each."""
    return chunks.select("id", F.to_json(record(target, collection)).alias("record"))


def envelope(target: str, collection: str | None = None) -> tuple[str, str]:
    """What stands before and after the comma-separated records in a file for bulk import."""
    name = json.dumps(collection or "webcontext")
    return {
        "pinecone": ('{"vectors":[', f'],"namespace":{json.dumps(collection or "")}}}'),
        "chroma": (f'{{"collection":{name},"documents":[', "]}"),
        "qdrant": (f'{{"collection":{name},"points":[', "]}"),
    }.get(target, ("[", "]"))


def bulk(chunks: DataFrame, target: str, collection: str | None = None, group: str = "source_url") -> DataFrame:
    """(group, document): one file for bulk import for each group of chunks."""
    before, after = envelope(target, collection)
    rows = chunks.select(F.col(group), F.col("chunk_index"), F.to_json(record(target, collection)).alias("__r"))
    return rows.groupBy(group).agg(F.concat(F.lit(before), _in_order("__r", "chunk_index", ","), F.lit(after)).alias("document"))


def write_records(chunks: DataFrame, path: str, target: str, collection: str | None = None) -> None:
    """A folder of JSON lines, written by all tasks."""
    exported(chunks, target, collection).select(F.col("record").alias("value")).write.mode("overwrite").text(path)


def loader_documents(chunks: DataFrame) -> DataFrame:
    """(page_content, metadata) as loaders of retrieval frameworks take them."""
    return chunks.select(F.col("content").alias("page_content"), F.struct(F.col("source_url").alias("source"), "title", F.col("heading_path").alias("headingPath"), F.col("chunk_index").alias("chunkIndex"), "tokens", F.col("has_code").alias("hasCode")).alias("metadata"))


EVENTS = ("crawl.complete", "crawl.error", "content.changed")


def notice(event: str, data: dict, timestamp: str, secret: str | None = None, headers: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """Body and headers of a notice to a subscriber; with a secret, signed by HMAC of SHA-256. Sending it is the caller's matter."""
    if event not in EVENTS:
        raise ValueError(f"no event {event}; there are {', '.join(EVENTS)}")
    body = json.dumps({"event": event, "timestamp": timestamp, "data": data}, separators=(",", ":"), ensure_ascii=False)
    out = {"Content-Type": "application/json"} | (headers or {})
    if secret:
        out["X-Webhook-Signature"] = hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    return body, out
