"""Native column expressions: detectors, predicates, text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

STOPWORDS = (
    "a i am an as at be by do he if in is it me my no of on or so to up we all and any are but can did few for had has her him his how its may nor not off "
    "our out own she the too was who why you also been both dare does down each from have here into just more most need once only over same some such than "
    "that them then they this very were what when whom will with your about above after again being could might other shall their there these those under "
    "where which would before during should because between further through "
).split()
#: In order of precedence.
FRAMEWORKS = "react vue angular svelte next.js nuxt express fastapi django flask spring rails tailwind bootstrap pytorch tensorflow".split()


def clean(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fingerprint(text: Column) -> Column:
    return F.sha2(clean(F.lower(text)), 256)


def tokens(text: Column) -> Column:
    """ASCII words of two letters or more that are not stopwords."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: (F.length(t) > 1) & ~t.isin(STOPWORDS))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words; the words are bound once, as a lambda's argument."""

    def runs(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.array_distinct(F.when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(many))

    return F.get(F.transform(F.array(F.split(clean(F.lower(text)), " ")), runs), F.lit(0))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def first_sentences(text: Column, n: int = 3) -> Column:
    # without what no mark ends, where the search would start anew at every character
    ended = F.regexp_extract(text, r"(?s)^(.*[.!?])", 1)
    found = F.regexp_extract_all(ended, F.lit("[^.!?]+[.!?]+"), F.lit(0))
    return F.trim(F.array_join(F.slice(found, 1, n), " "))


def chunk_id(url: Column, index: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", url, index.cast("string"), F.substring(content, 1, 64)), 256), 1, 16)


def _any(col: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (col.contains(p) for p in parts))


def is_pdf(url: Column) -> Column:
    return F.lower(url).endswith(".pdf") | _any(url, "/pdf/", "application/pdf")


def is_repo(url: Column) -> Column:
    return url.rlike(r"^https?://(www\.)?github\.com/[\w.-]+/[\w.-]+")


def repo_parts(url: Column) -> Column:
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    head = r"github\.com/"
    return F.struct(
        part(head + r"([^/]+)/").alias("owner"),
        part(head + r"[^/]+/([^/#?]+)").alias("repo"),
        part(head + r"[^/]+/[^/]+/(?:tree|blob)/([^/]+)").alias("branch"),
        part(head + r"[^/]+/[^/]+/(?:tree|blob)/[^/]+/(.+)").alias("path"),
    )


def url_matches(url: Column, include: list[str], exclude: list[str]) -> Column:
    inside = _any(url, *include) if include else F.lit(True)
    return inside & ~_any(url, *exclude) if exclude else inside


def content_type(url: Column, has_article: Column, has_readme: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(_any(low, "/api", "/reference"), "api-reference")
        .when(_any(low, "/docs", "/documentation"), "documentation")
        .when(_any(low, "/blog") | has_article, "blog-post")
        .when(low.contains("github.com") & low.contains("/readme") | has_readme, "readme")
        .when(_any(low, "/tutorial", "/guide"), "tutorial")
        .when(_any(low, "/changelog", "/releases"), "changelog")
        .otherwise("unknown")
    )


def framework(text: Column, url: Column) -> Column:
    """The first known name that the lower-cased text or the URL contains."""
    low = F.lower(text)
    return reduce(lambda c, f: c.when(low.contains(f) | url.contains(f), f), FRAMEWORKS[1:], F.when(low.contains(FRAMEWORKS[0]) | url.contains(FRAMEWORKS[0]), FRAMEWORKS[0]))


def version(text: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)(?:v|version\s*)(\d+\.\d+(?:\.\d+)?(?:-[\w.]+)?)", 0)), F.lit(""))


def cron_seconds(cron: Column) -> Column:
    f = F.split(F.trim(cron), r"\s+")
    minute, hour, day = (F.get(f, F.lit(i)) for i in range(3))
    number = lambda c: c.rlike(r"^\d+$")
    step = lambda c: F.regexp_extract(c, r"^\*/(\d+)$", 1)
    return (
        F.when(F.size(f) < 5, 3600)
        .when(step(minute) != "", F.try_to_number(step(minute), F.lit("999999")) * 60)
        .when(step(hour) != "", F.try_to_number(step(hour), F.lit("999999")) * 3600)
        .when(number(minute) & number(hour) & (day == "*"), 86400)
        .when(number(minute) & (hour == "*"), 3600)
        .when(minute == "*", 60)
        .otherwise(3600)
        .cast("long")
    )


def code_language(code: Column) -> Column:
    """Ordered rules; the first that holds names the language."""
    has = lambda *p: _any(code, *p)
    rules = [
        ("python", has("import ") & has("from ")),
        ("typescript", has("interface ", ": string")),
        ("javascript", has("const ", "let ", "=>")),
        ("go", has("func ") & has(":=")),
        ("rust", has("fn ") & has("->")),
        ("java", has("public class", "System.out")),
        ("csharp", has("using System") | has("namespace") & has("public static")),
        ("kotlin", has("fun ") & has("val ", "package")),
        ("swift", has("import Foundation") | has("func ") & has("let ")),
        ("ruby", has("def ") & has("end")),
        ("php", has("<?php")),
        ("sql", code.rlike(r"\b(?:CREATE TABLE|INSERT|SELECT|UPDATE)\b")),
        ("bash", code.startswith("#!/bin/bash") | code.rlike(r"(?m)^\s*\$")),
        ("html", code.rlike(r"^\s*<") & code.rlike(r"<\w+[\s>]")),
        ("css", code.rlike(r"\{[^}]*(?:font|display|padding|margin|color)\s*:")),
        ("yaml", code.rlike(r"(?m)^[\w-]+\s*:(?:\s|$)") & ~has("{")),
    ]
    return reduce(lambda c, r: c.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise("text")
