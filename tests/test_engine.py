"""Golden cases derived by hand."""

import pytest
from pyspark.sql import functions as F

from loomtext.engine import ChunkOptions, CrawlOptions, Engine
from loomtext.functions import chunking, html5, markdown
from loomtext.functions import columns as C
from loomtext.operators import crawl, documents, extract, output, rate
from loomtext.sources import web

FENCE = "`" * 3


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_single_document_has_no_scores(spark):
    docs = spark.createDataFrame([(1, "apple pie")], "doc_id long, text string")
    assert documents.search(docs, docs.selectExpr("doc_id as query_id", "text")).count() == 0


def test_search_scores(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "durian fig")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "apple banana")], "query_id long, text string")
    got = [(r.doc_id, r.score) for r in documents.search(docs, q).orderBy("rank").collect()]
    assert got == [(1, 0.985402), (2, 0.119883)]


def test_tokens(spark):
    assert one(spark, "The étion of A B2!", C.tokens) == ["tion", "b2"]


def test_code_in_pre_counts_twice():
    page = extract.extract_page('<article><pre><code class="language-js">x</code></pre></article>', "https://h/a")
    assert [(b["language"], b["code"]) for b in page["code_blocks"]] == [(None, "x"), ("js", "x")]


def test_title_after_noise_removal():
    assert extract.extract_page("<title>T</title><header><h1>H</h1></header>", "https://h")["title"] == "T"


def test_substring_noise():
    assert extract.extract_page('<body><div class="thread-list">gone</div>stays</body>', "https://h")["text"] == "stays"


@pytest.mark.parametrize(("code", "language"), [("let x = a -> b", "javascript"), ("func f() { x := 1 }", "go"), ("name: x", "yaml"), ("SELECT 1", "sql"), ("plain", "text")])
def test_code_language(spark, code, language):
    assert one(spark, code, C.code_language) == language


def test_version(spark):
    assert one(spark, "released v2.10.3-beta.1 now", C.version) == "v2.10.3-beta.1"
    assert one(spark, "Version 3.4", C.version) == "Version 3.4"


@pytest.mark.parametrize(("url", "kind"), [("https://h/apiary", "api-reference"), ("https://blog.h/x", "blog-post"), ("https://h/tutorial/1", "tutorial")])
def test_content_type(spark, url, kind):
    assert one(spark, url, lambda u: C.content_type(u, F.lit(False), F.lit(False))) == kind


def test_endpoints():
    blocks = extract.extract_page("<body>GET /v1/users and POST /v1/x</body>", "https://h", "api")["code_blocks"]
    assert [b["code"] for b in blocks] == ["GET /v1/users", "POST /v1/x"]


def test_table_spans():
    grid = lambda t: markdown.table_grid(next(n for n in html5.parse(t).walk() if n.tag == "table"))
    assert grid("<table><tr><td>A</td><td rowspan=2>B</td></tr><tr><td>C</td></tr></table>") == [["A", "B"], ["B", "C"]]
    assert grid("<table><tr><td colspan=2>X</td></tr></table>") == [["X", ""]]


def test_markdown():
    assert markdown.convert("<h2>T</h2><p>a <b>b</b> <a href='/x'>l</a></p><ul><li>1</li><li>2</li></ul>") == "## T\n\na **b** [l](/x)\n\n- 1\n- 2"
    assert markdown.convert("<pre><code class='lang-py'>x\n</code></pre>") == f"{FENCE}py\nx\n{FENCE}"
    assert markdown.post_process("a\n# b") == "a\n\n# b"
    assert markdown.resolve_links("[t](../b)", "https://h/a/c/d") == "[t](https://h/a/b)"
    assert markdown.convert("<p><b>x<br><p>y</p>").count("**") == 4


def test_chunk_rules():
    assert chunking.chunk_id("u", 0, "abc") == "8dd86946a3a2bfd6"
    assert chunking.split("x" * 100, "fixed", 5, 0) == ["x" * 100]
    for s in ("semantic", "heading", "fixed", "paragraph"):
        assert chunking.split("", s) == []
    text = "# A\na\n## B\nb\n# C\nc"
    assert chunking.heading_path("# C\nc", text, [(1, "A"), (2, "B"), (1, "C")]) == ["C", "B"]
    parts = chunking.split("one two three\n\nfour five six\n\nseven", "paragraph", 4, 0)
    assert "".join("".join(parts).split()) == "onetwothreefourfivesixseven"


def test_dedup(spark):
    docs = spark.createDataFrame([(1, "Hello  World"), (2, " hello world\n"), (3, None), (4, "x")], "doc_id long, text string")
    assert [r.doc_id for r in documents.dedup(docs).orderBy("doc_id").collect()] == [1, 3, 4]
    assert documents.duplicates(docs).collect()[0].asDict() == {"duplicate": 2, "original": 1}


def test_diff(spark):
    old = spark.createDataFrame([("u", "# A\n# B\n# B")], "url string, markdown string")
    new = spark.createDataFrame([("u", "# B\n# C")], "url string, markdown string")
    r = documents.diff(old, new).first()
    assert (r.changed, r.added, r.removed) == (True, ["C"], ["A"])


def test_summary(spark):
    assert one(spark, "A b. C d! E? F.", C.first_sentences) == "A b.  C d!  E?"


def test_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([("s", 1, 10), ("s", 2, 50), ("s", 3, 5)], "g string, i int, tokens int")
    assert [r.i for r in output.within_budget(rows, 20, "g", "i").collect()] == [1]


def test_url_rules(spark):
    assert one(spark, "https://h/docs/x", lambda u: C.url_matches(u, ["docs"], ["x"])) is False
    assert [one(spark, u, C.is_pdf) for u in ("A.PDF", "/pdf/1", "/PDF/1", "a.pdf?d=1")] == [True, True, False, False]


def test_edges_keep_repeats(spark):
    pages = spark.createDataFrame([("P1", [("P2",), ("P2",), ("P1",), ("P9",)]), ("P2", [])], "url string, links array<struct<href:string>>")
    assert [(r.src, r.dst) for r in documents.edges(pages).collect()] == [("P1", "P2")] * 2


def test_bucket(spark):
    rows = spark.createDataFrame([(i, "h", 0.0) for i in range(6)], "id long, key string, at double")
    assert [r.wait for r in rate.token_bucket(rows).orderBy("id").collect()] == [0, 0, 0, 0, 0, 0.5]


def test_cache_ttl(spark):
    asked = spark.createDataFrame([("a",), ("b",)], "url string")
    stored = asked.selectExpr("md5(url) url_key", "timestamp_seconds(if(url = 'a', 0, -1)) ts")
    got = {r.url: r.hit for r in documents.cached(asked, stored, F.timestamp_seconds(F.lit(3600))).collect()}
    assert got == {"a": True, "b": False}


def test_fetch_retries(spark):
    def fetcher(url):
        return ("ok", 200) if url == "good" else ("", 404)

    got = {r.url: (r.html, r.error) for r in web.fetch(spark.createDataFrame([("good",), ("bad",)], "url string"), fetcher, wait=lambda s: None).collect()}
    assert got == {"good": ("ok", None), "bad": (None, "HTTP 404")}


def test_exports(spark):
    import json

    pages = spark.createDataFrame([("u", "t", "some text", None)], "url string, title string, markdown string, headings array<struct<level:int,text:string>>")
    chunks = Engine(spark, ChunkOptions(strategy="fixed")).chunks(pages)
    rec = {t: json.loads(output.exported(chunks, t).first().record) for t in ("pinecone", "chroma", "weaviate", "qdrant")}
    assert rec["pinecone"]["metadata"]["content"] == "some text" and "namespace" not in rec["pinecone"]["metadata"]
    assert rec["chroma"]["document"] == "some text" and rec["weaviate"]["class"] == "WebContent" and rec["qdrant"]["payload"]["source"] == "u"


def test_options():
    for bad in ({"depth": 11}, {"max_pages": 0}, {"timeout": 999}, {"delay": 60_001}):
        with pytest.raises(ValueError):
            CrawlOptions(**bad)


def test_hooks(spark):
    engine = Engine(spark)
    engine.on("post-extract", lambda df: df.withColumn("title", F.upper("title")))
    pages = spark.createDataFrame([("https://h/a", "<title>t</title>")], "url string, html string")
    assert engine.extract(pages).first().title == "T"


def test_stream_equals_batch(spark, sf, tmp_path):
    from loomtext.streaming import pages as streaming

    folder = tmp_path / "in"
    spark.read.parquet(f"{sf}/pages.parquet").write.parquet(str(folder))
    out = str(tmp_path / "out")
    streaming.stream_chunks(streaming.read_pages(spark, str(folder)), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "check")).awaitTermination()
    batch = documents.chunk(extract.extract(spark.read.parquet(f"{sf}/pages.parquet")))
    assert sorted(r.id for r in spark.read.parquet(out).select("id").collect()) == sorted(r.id for r in batch.select("id").collect())


def test_deep_and_failing_pages(spark, monkeypatch):
    deep = "<body>" + "<div>" * 5000 + "deep" + "</div>" * 5000
    pages = spark.createDataFrame([(1, "https://h/a", deep), (2, "https://h/a", "<body>x</body>"), (3, None, None)], "k long, url string, html string")
    got = {r.k: (r.text, r.markdown, r.error) for r in extract.extract(pages, keep=("k",)).collect()}
    assert got == {1: ("deep", "deep", None), 2: ("x", "x", None), 3: ("", "", None)}
    bad = extract._row("<p>x", "http://[", "full", False)
    assert bad["error"].startswith("ValueError")


def test_robots_groups(spark):
    body = "Disallow: /early\nUser-agent: *\nDisallow: /\nUser-agent: mybot\nUser-agent: twin\nDisallow: /x*y$\nAllow: /x\n\nUser-agent: free\nDisallow:"
    rules = web.robots_rules(spark.createDataFrame([("https://h", body)], "origin string, body string"))
    urls = spark.createDataFrame([(u,) for u in ("https://h/a", "https://h/x1y", "https://h/x1yz", "https://h", "https://other/q")], "url string")
    judge = lambda agent: {r.url.replace("https://", ""): r.allowed for r in web.allowed(urls, rules, agent).collect()}
    assert judge("MyBot/2.1") == judge("twin") == {"h/a": True, "h/x1y": False, "h/x1yz": True, "h": True, "other/q": True}
    assert not judge("stranger")["h/a"] and not judge("stranger")["h"] and all(judge("free").values())


SITE = {
    "https://h/": "<article>home " + "w " * 150 + "<a href='/a'>a</a><a href='/b'>b</a><a href='https://other/'>o</a><a href='/private/x'>p</a></article>",
    "https://h/a": "<article>page a. It is long. Third here. " + "v " * 150 + "<a href='/'>home</a><a href='/c'>c</a></article>",
    "https://h/b": "<article>page a. It is long. Third here. " + "v " * 150 + "<a href='/'>home</a><a href='/c'>c</a></article>",
    "https://h/c": "<article>page c " + "u " * 150 + "<a href='/d'>d</a></article>",
}


def site_fetcher():
    site = dict(SITE)

    def fetch_site(url):
        if url == "https://h/d":
            raise OSError("no route")
        return (site[url], 200) if url in site else ("", 404)

    return fetch_site


def test_crawl(spark, tmp_path):
    waits = []
    fetch = web.fetching(site_fetcher(), retries=1, wait=lambda s: None)
    engine = Engine(spark)
    rules = spark.createDataFrame([("https://h", "User-agent: *\nDisallow: /private")], "origin string, body string")
    cache = crawl.PageCache(spark, str(tmp_path / "cache"))
    options = CrawlOptions(depth=3)
    got = engine.crawl("https://h/", fetch, options, robots=rules, cache=cache, now="2024-01-01 00:00:00")
    # b is a copy of a, whose links are not followed; other hosts are not internal
    assert [(r.url, r.depth) for r in got.pages.orderBy("depth", "seq").collect()] == [("https://h/", 0), ("https://h/a", 1), ("https://h/c", 2)]
    assert {(r.url, r.error, r.status_code) for r in got.errors.collect()} == {("https://h/private/x", "denied by robots.txt", None), ("https://h/d", "no route", None)}
    assert {(r.src, r.dst) for r in got.relationships.collect()} == {("https://h/", "https://h/a"), ("https://h/a", "https://h/"), ("https://h/a", "https://h/c")}
    packet = got.packet.first()
    assert packet.page_count == 3 and packet.total_tokens == sum(r.tokens for r in got.chunks.collect()) and len(packet.relationships) == 3
    assert packet.summary.startswith("home w") and packet.summary.endswith("Third here.")
    assert got.stats.first().cache_hits == 0
    text = engine.context(got, 8000)
    assert text.startswith("# https://h/\n\n> home") and f"> 3 pages | {packet.total_tokens} tokens | blog-post" in text
    assert engine.markdown(got).count("\n\n---\n\n") == 2
    # a second crawl takes all pages from the cache, so nothing is fetched but what failed
    again = engine.crawl("https://h/", lambda urls: fetch(urls.where("url like '%/d' or url like '%/b'")), options, robots=rules, cache=cache, now="2024-01-01 00:30:00")
    assert sorted(r.url for r in again.pages.collect()) == ["https://h/", "https://h/a", "https://h/c"] and again.stats.first().cache_hits == 3
    assert cache.size() == 3 and cache.has("https://h/a", "2024-01-01 00:30:00") and not cache.has("https://h/a", "2024-01-01 02:00:01")
    cache.invalidate("https://h/a", "2024-01-01 00:40:00")
    assert cache.size() == 2 and not cache.has("https://h/a", "2024-01-01 00:40:00")
    cache.clear()
    assert cache.size() == 0
    assert waits == []


def test_crawl_limits_seeds_and_checkpoint(spark, tmp_path):
    fetch = web.fetching(site_fetcher(), retries=0, wait=lambda s: None)
    start = lambda: spark.createDataFrame([("https://h/", 0)], "url string, seq long")
    assert crawl.crawl(start(), fetch, 3, max_pages=2).pages.count() == 2
    saved = crawl.Checkpoint(spark, str(tmp_path / "c"))
    assert crawl.crawl(start(), fetch, 1, exclude=("/b",), checkpoint=saved).pages.count() == 2
    level, state = saved.load()
    assert level == 1 and state["visited"].count() == 3
    maps = spark.createDataFrame([("https://h/sitemap.xml", "<urlset><url><loc>https://h/c</loc></url><url><loc>https://h/z?a=1&amp;b=2</loc></url></urlset>")], "url string, xml string")
    found = lambda **o: [r.url for r in crawl.seeds(spark, "https://h/", sitemaps=maps, **({"depth": 1, "max_pages": 9} | o)).orderBy("seq").collect()]
    assert found() == ["https://h/c", "https://h/z?a=1&b=2"] and found(exclude=("z",)) == ["https://h/c"] and found(depth=0) == ["https://h/"] and found(include=("none",)) == ["https://h/"]
    with pytest.raises(ValueError):
        Engine(spark).crawl("ftp://h/", fetch)


def test_cache_bound(spark, tmp_path):
    cache = crawl.PageCache(spark, str(tmp_path), max_size=2)
    for i in range(4):
        cache.put(spark.createDataFrame([(f"u{i}", "t")], "url string, title string"), f"2024-01-01 00:00:0{i}")
    assert sorted(r.url for r in cache.rows().collect()) == ["u2", "u3"]


def test_templates(spark):
    page = spark.createDataFrame([("T", "U", "abcde", "D")], "title string, url string, markdown string, description string")
    t = output.Templates()
    text = lambda name: t.pages(page, name).first().rendered
    assert text("llm") == '<context source="U" tokens="2">\nabcde\n</context>'
    assert text("default") == "# T\n\nSource: U\n\nabcde" and text("summary") == "## T\n\n> D\n\n**Source:** U | **Tokens:** 2\n\n---\n\nabcde"
    t.register("own", "{{title}}-{{nothing}}")
    assert text("own") == "T-{{nothing}}" and "own" in t.names()
    with pytest.raises(ValueError):
        text("missing")
    two = spark.createDataFrame([("g", 2, "T", "U", "b", None), ("g", 1, "S", "V", "a", None)], "g string, n int, title string, url string, markdown string, description string")
    assert t.joined_pages(two, "g", "n", "minimal").first().rendered == "a\n\n---\n\nb"
    packets = spark.createDataFrame([("s", "sum", 7)], "source string, summary string, total_tokens long")
    chunks = spark.createDataFrame([("s", 2, "y"), ("s", 1, "x")], "source string, seq int, content string")
    assert t.contexts(packets, chunks, "llm").first().rendered == '<context source="s" tokens="7">\nx\n\ny\n</context>'


def test_bulk_exports(spark, tmp_path):
    import json

    pages = spark.createDataFrame([("u", "t", "some text", None)], "url string, title string, markdown string, headings array<struct<level:int,text:string>>")
    chunks = Engine(spark, ChunkOptions(strategy="fixed")).chunks(pages)
    whole = lambda target, name=None: json.loads(output.bulk(chunks, target, name).first().document)
    assert whole("pinecone")["namespace"] == "" and whole("pinecone", "n")["vectors"][0]["metadata"]["namespace"] == "n"
    assert whole("chroma")["collection"] == "webcontext" and "totalChunks" not in whole("chroma")["documents"][0]["metadata"]
    assert whole("weaviate", "C")[0]["class"] == "C" and whole("qdrant", "q")["points"][0]["payload"]["totalChunks"] == 1
    assert whole("json")[0]["metadata"]["sourceUrl"] == "u"
    output.write_records(chunks, str(tmp_path / "out"), "json")
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["content"] == "some text"
    assert output.loader_documents(chunks).first().metadata.source == "u"
    with pytest.raises(ValueError):
        output.record("other")


def test_notices():
    body, headers = output.notice("crawl.error", {"url": "u"}, "2024-01-01T00:00:00Z", "key")
    assert body == '{"event":"crawl.error","timestamp":"2024-01-01T00:00:00Z","data":{"url":"u"}}'
    import hashlib
    import hmac

    assert headers["X-Webhook-Signature"] == hmac.new(b"key", body.encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        output.notice("other", {}, "")


def test_repositories(spark):
    repos = spark.createDataFrame([("https://github.com/o/r",), ("https://github.com/o/none",), ("https://h/o/r",)], "repo_url string")
    md = "# Title\n\nSee [doc](docs/a.md) and [site](https://s/).\n\n" + FENCE + "py\nx = 1\n" + FENCE
    files = spark.createDataFrame([("https://raw.githubusercontent.com/o/r/master/README.md", "old"), ("https://raw.githubusercontent.com/o/r/main/readme.md", md)], "url string, body string")
    (r,) = web.readmes(repos, files).collect()
    assert (r.url, r.title, r.author, r.markdown) == ("https://github.com/o/r", "o/r", "o", md)
    assert [(x.href, x.text, x.is_internal) for x in r.links] == [("https://github.com/o/r/blob/main/docs/a.md", "doc", True), ("https://s/", "site", False)]
    assert [(h.level, h.text) for h in r.headings] == [(1, "Title")] and [(c.language, c.code) for c in r.code_blocks] == [("py", "x = 1")]
    listing = spark.createDataFrame([("a.md", "file", "d1", "h1"), ("b.md", "file", "d2", "h2"), ("c.txt", "file", "d1", "h3"), ("d.md", "dir", "d1", "h4")], "name string, kind string, download_url string, html_url string")
    bodies = spark.createDataFrame([("d1", "# A\ntext"), ("d2", "no head")], "url string, body string")
    assert sorted((x.url, x.title) for x in web.docs_folder(listing, bodies).collect()) == [("h1", "A"), ("h2", "b")]


def test_pdf(spark):
    import zlib

    stream = zlib.compress(b"BT /F1 12 Tf (1. Intro) Tj 0 -14 Td [(some) -250 ( text \\(x\\))] TJ ET")
    data = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Title (The\\040T) /Author (A)>> endobj\n3 0 obj <</Length 1 /Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj"
    files = spark.createDataFrame([("f/a.pdf", bytearray(data)), ("f/b.PDF", bytearray(b"junk")), ("f/c.pdf", None)], "url string, content binary")
    got = {r.url: r for r in web.pdf_pages(files).collect()}
    a = got["f/a.pdf"]
    assert (a.title, a.author, a.text) == ("The T", "A", "1. Intro\nsome text (x)") and [h.text for h in a.headings] == ["1. Intro"]
    assert a.markdown == "# The T\n\n> Author: A\n\n> 1 pages\n\n1. Intro\nsome text (x)"
    assert got["f/b.PDF"].title == "b" and got["f/b.PDF"].error == "not a PDF" and got["f/c.pdf"].error


def test_images(spark):
    rows = spark.createDataFrame([([("s", "alt", "t", None), ("s2", "", None, "ctx"), ("s3", "", None, None)],)], "images array<struct<src:string,alt:string,title:string,context:string>>")
    assert rows.select(web.image_markdown(F.col("images")).alias("m")).first().m == '![alt](s "t")\n\n![ctx](s2)'


def test_index_grows(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "durian fig")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "apple banana")], "query_id long, text string")
    index = documents.SearchIndex().add(docs.where("doc_id < 3"))
    index.search(q)
    index.add(docs.where("doc_id = 3"))
    assert [(r.doc_id, r.score) for r in index.search(q).orderBy("rank").collect()] == [(1, 0.985402), (2, 0.119883)] and index.size() == 3
    index.clear()
    assert index.size() == 0 and index.search(q).count() == 0


def test_register(spark, tmp_path):
    register = documents.Register(spark, str(tmp_path / "r"))
    docs = spark.createDataFrame([(1, "Hello  World"), (2, " hello world\n"), (4, "x")], "doc_id long, text string")
    register.add(docs)
    assert register.size() == 2 and register.new(docs).count() == 0
    assert [r.doc_id for r in register.new(spark.createDataFrame([(5, "X"), (6, "y")], "doc_id long, text string")).collect()] == [6]
    register.clear()
    assert register.size() == 0


def test_valid_urls(spark):
    urls = ["https://h/a", "http://h", "ftp://h/", "h/a", "", None, "https:///x"]
    got = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", web.valid_url(F.col("u")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [True, True, False, False, False, False, False]


def test_markdown_golden():
    nested = "<ul><li>a<ul><li>b</li><li>c<ol start=3><li>d</li></ol></li></ul></li><li>e</li></ul>"
    assert markdown.convert(nested).split("\n")[0] == "- a" and "  - b" in markdown.convert(nested) and "3. d" in markdown.convert(nested)
    assert markdown.convert("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td></tr></table>") == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert markdown.convert("<p>x <del>gone</del> y</p>") == "x ~~gone~~ y"
    assert markdown.convert("<details><summary>S</summary><p>in</p></details>") == "<details>\n<summary>S</summary>\n\nin\n\n</details>"
    assert markdown.convert("<blockquote><p>[!NOTE]</p><p>text</p></blockquote>").startswith("> ")
    assert markdown.convert("<p>a<a href='/x'></a>b <img src=s alt=t></p>") == "ab [Image: t]" and markdown.convert("<img src=s alt=t title=u>", True) == '![t](s "u")'


def test_chunk_rules_of_fences_and_overlap():
    fenced = f"one {FENCE}py"
    assert chunking.merge_fences([fenced, f"x {FENCE}", "y"], 10, chunking.estimate) == [f"{fenced}\n\nx {FENCE}", "y"]
    assert chunking.merge_fences([fenced, "x" * 100, "y"], 10, chunking.estimate) == [fenced, "x" * 100, "y"]
    assert chunking.overlap_suffix("aa bb cc dd", 1, chunking.estimate) == "dd" and chunking.overlap_suffix("aa bb cc dd", 2, chunking.estimate) == "bb cc dd"
    got = chunking.split("aaaa bbbb\ncccc dddd", "fixed", 3, 2)
    assert got == ["aaaa bbbb", "bbbb\ncccc dddd"]


def test_first_arrivals(spark, tmp_path):
    from loomtext.streaming import pages as streaming

    rows = spark.createDataFrame([("2024-01-01 00:00:00", "a"), ("2024-01-01 00:01:00", " A "), ("2024-01-01 00:02:00", "b")], "t string, text string").selectExpr("cast(t as timestamp) t", "text")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.first_arrivals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.fingerprint for r in spark.read.parquet(str(tmp_path / "out")).select("fingerprint").collect()) == sorted(r.f for r in rows.select(C.fingerprint(F.col("text")).alias("f")).distinct().collect())


def test_small_sources(spark, tmp_path):
    assert one(spark, "User-agent: *\nsitemap:  https://h/s.xml ", web.sitemap_of_robots) == "https://h/s.xml"
    (tmp_path / "a.txt").write_text("x\ny")
    assert web.read_files(spark, str(tmp_path)).first().body == "x\ny"
    assert documents.token_counter("/opt/tokenizers/byte_bpe_50k.tiktoken")("hello world") == 2


def test_fixed_chunks_in_a_fence_gain_no_line():
    """A fence that is cut leaves both chunks as they are, whether or not a line's end would still fit the first."""
    for width in range(1, 9):
        text = f"{'x' * width}\n{FENCE}python\n# one\nprint(1)\nprint(22)\n{FENCE}\nlast"
        plain = chunking.split(text, "fixed", 6, 0, keep_code=False)
        assert chunking.split(text, "fixed", 6, 0) == plain
        assert "\n".join(plain) == text
