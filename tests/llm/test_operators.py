"""The training-data operators against brute force, and on nulls, empties, repeats and clashing columns."""

import collections
import itertools
import random

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtext.llm import bpe, cascade, collinear, fm_index, license_scan, metric_join, packing, page_diff, queries, sais, site_lines, suffix_dedup, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, pos string, keep string, size string, __x int"
VOCABULARY = [f"w{i}x" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def odd_rows():
    """Copies, passages, nulls, blanks, repeated rows, a long text."""
    a, b, long = prose(1, 300), prose(2, 120), prose(3, 60_000)
    changed = a.split()
    changed[50], changed[200] = "zebra", "yak"
    rows = [
        (1, a, "s"), (2, a, "s"), (3, " ".join(changed), "t"), (4, prose(4, 80) + " " + b + " " + prose(5, 90), None), (5, prose(6, 70) + "\n" + b, "s"),
        (6, None, "s"), (7, "", None), (8, "   \n ", "t"), (9, "one", "t"), (10, "one", "t"), (None, a, "s"), (1, a, "s"), (11, long, "t"), (12, prose(7, 50) + " " + long[:5000], "t"), (13, prose(8, 200), "u"),
    ]
    return [(i, t, "en", s, len(t or ""), "h", "p", "k", "z", 7) for i, t, s in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def tokenized(frame):
    frame = frame[frame.doc_id.notna()].drop_duplicates("doc_id").sort_values("doc_id")
    return frame.doc_id.astype(int).to_numpy(), words.tokenize(pa.array(frame.text.where(frame.text.notna(), None), pa.string()))


def windows(ids, w, n):
    """Document and place of each n-word window that a document of lower id has."""
    first, out = {}, []
    for d, a, b in zip(ids, w.ptr[:-1], w.ptr[1:]):
        h = w.hash[a:b].tobytes()
        for p in range(b - a - n + 1):
            if first.setdefault(h[8 * p : 8 * (p + n)], d) < d:
                out.append((int(d), p))
    return out


def covered(rows):
    return {(d, p) for d, a, b in rows for p in range(a, b)}


def test_induced_sorting():
    r = np.random.default_rng(0)
    for trial in range(200):
        t = np.repeat(r.integers(0, r.integers(1, 9), r.integers(1, 60)), r.integers(1, 4)) * r.choice([1, 70_000])
        small, sais.SMALL = sais.SMALL, 1
        try:
            sa = sais.suffix_array(t)
        finally:
            sais.SMALL = small
        rows = t.tolist()
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: rows[i:]), trial
        lcp = sais.common_prefixes(t, sa)
        for x, y in itertools.pairwise(sa.tolist()):
            k = 0
            while max(x, y) + k < len(rows) and rows[x + k] == rows[y + k]:
                k += 1
            assert lcp[y] == k


@pytest.mark.parametrize("which", ["table", "odd"])
def test_suffix_dedup_is_exact(request, which):
    docs = request.getfixturevalue(which)
    n = suffix_dedup.MIN_WORDS
    want = {(d, p + k) for d, p in windows(*tokenized(docs.toPandas()), n) for k in range(n)}
    got = suffix_dedup.repeated_spans(docs, shard_words=5000).toPandas()
    assert covered(got.itertuples(index=False)) == want
    assert want


@pytest.mark.parametrize("which", ["table", "odd"])
def test_collinear_finds_shared_passages(request, which):
    docs = request.getfixturevalue(which)
    got = collinear.repeated_passages(docs).toPandas()
    spans = covered(got[["doc_id", "start_word", "end_word"]].itertuples(index=False))
    n = 50
    want = {(d, p + k) for d, p in windows(*tokenized(docs.toPandas()), n) for k in range(n)}
    assert len(want - spans) <= 0.02 * len(want)
    assert (got.doc_id > got.source_doc_id).all() and (got.matched_words >= collinear.MIN_WORDS).all()


def test_collinear_spans_an_edit(spark):
    a = prose(1, 300).split()
    b = [*a[:100], "new", *a[101:150], *a[151:]]
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
    r = collinear.repeated_passages(docs).collect()
    assert [(x.start_word, x.end_word, x.matched_words) for x in r] == [(0, 299, 298)]


def edited(r, text, rate):
    """A copy with that share of its words replaced, at places drawn without repeats."""
    text = text[:]
    for i in r.sample(range(len(text)), int(rate * len(text))):
        text[i] = f"new{r.randrange(10**9)}"
    return text


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.15, 0.19])
def test_collinear_recall_of_edited_passages(spark, rate):
    r = random.Random(rate)
    rows, lengths = [], [60, 100, 200]
    for n in range(120):
        own = [f"p{n}q{i}" if r.random() < 0.5 else r.choice(VOCABULARY) for i in range(lengths[n % 3])]
        rows += [(n, f"{prose(f'a{n}', 80)} {' '.join(own)} {prose(f'b{n}', 80)}"), (1000 + n, f"{prose(f'c{n}', 80)} {' '.join(edited(r, own, rate))} {prose(f'd{n}', 80)}")]
    got = collections.defaultdict(int)
    for x in collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x.doc_id, x.source_doc_id] += min(x.end_word, 80 + lengths[x.doc_id % 1000 % 3]) - max(x.start_word, 80)
    for kind, length in enumerate(lengths):
        found = [got[1000 + n, n] >= length / 2 for n in range(kind, 120, 3)]
        assert sum(found) >= 0.9 * len(found), (length, sum(found), len(found))


def test_collinear_passage_whose_parts_stand_in_earlier_documents(spark):
    rows = []
    for n in range(40):
        p = prose(f"p{n}", 60).split()
        first, last = " ".join(p[: 24 + n % 14]), " ".join(p[24 + n % 14 :])
        near = lambda x: f"{prose(f'{x}{n}', 50)} {{}} {prose(f'{x}{n}z', 50)}"  # noqa: B023, E731
        rows += [(n, near("a").format(first)), (100 + n, near("b").format(last)), (200 + n, near("c").format(" ".join(p))), (300 + n, near("d").format(" ".join(p)))]
    got = collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x.doc_id, x.source_doc_id) for x in got if x.doc_id >= 300 and x.start_word <= 50 and x.end_word >= 110} == {(300 + n, 200 + n) for n in range(40)}


def test_collinear_passage_whose_parts_are_frequent(spark):
    """All seeds of the passage are in more documents than are linked, and their first documents hold only parts of it."""
    p = prose("frequent", 64).split()
    near = lambda n, words: f"{prose(f'before{n}', 50)} {' '.join(words)} {prose(f'after{n}', 50)}"
    parts = [p[a : a + 39] for a in (0, 6, 12, 18, 25)]
    rows = [(20 * i + n, near(20 * i + n, part)) for i, part in enumerate(parts) for n in range(20)]
    rows += [(n, near(n, p)) for n in (200, 201, 202)]
    found = collections.defaultdict(set)
    for x in collinear.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[x.doc_id, x.source_doc_id].update(range(x.start_word, x.end_word))
    assert all(found[n, 200] >= set(range(50, 114)) for n in (201, 202))


def test_chain_is_optimal():
    r = random.Random(1)
    for _ in range(100):
        n = r.randint(1, 8)
        at = sorted({(r.randint(0, 40), r.randint(0, 40)) for _ in range(n)})
        top = 0.0
        for k in range(1, len(at) + 1):
            for c in itertools.combinations(at, k):
                if all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(c)):
                    top = max(top, 10 * k - 0.125 * (c[-1][0] - c[0][0] + c[-1][1] - c[0][1]))
        best = collinear.chain([p for p, _ in at], [q for _, q in at], 10)[0]
        got = 10 * len(best) - 0.125 * (best[-1][0] - best[0][0] + best[-1][1] - best[0][1])
        assert abs(got - top) < 1e-9


def brute_groups(frame, tau):
    ids, w = tokenized(frame)
    g, ptr = metric_join.gram_sets(w, metric_join.N)
    sets = [set(g[a:b].tolist()) for a, b in zip(ptr[:-1], ptr[1:])]
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= tau * len(sets[i] | sets[j]) - 1e-9:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    of = {int(ids[i]): int(ids[find(i)]) for i in range(len(ids))}
    n = collections.Counter(of.values())
    return {d: g for d, g in of.items() if n[g] > 1}


@pytest.mark.parametrize("hot", [4, metric_join.HOT])
@pytest.mark.parametrize(("which", "tau"), [("table", metric_join.TAU), ("odd", metric_join.TAU), ("table", 0.3)])
def test_jaccard_counts_every_link(request, which, tau, hot):
    docs = request.getfixturevalue(which)
    ids, w = tokenized(docs.toPandas())
    g, ptr = metric_join.gram_sets(w, metric_join.N)
    sets = {int(d): set(g[a:b].tolist()) for d, a, b in zip(ids, ptr[:-1], ptr[1:]) if b > a}
    near = collections.defaultdict(list)
    for x, y in itertools.combinations(sets, 2):
        share = len(sets[x] & sets[y]) / len(sets[x] | sets[y])
        if share >= tau - 1e-9:
            near[x].append((-share, y)), near[y].append((-share, x))
    want = {d: (len(at), min(at)[1], round(-min(at)[0], 6)) for d, at in near.items()}
    assert {r.doc_id: (r.links, r.partner_id, r.jaccard) for r in metric_join.groups(docs, tau=tau, hot=hot).collect()} == want


@pytest.mark.parametrize(("which", "tau"), [("table", metric_join.TAU), ("odd", metric_join.TAU), ("table", 0.3)])
def test_jaccard_groups_are_exact(request, which, tau):
    docs = request.getfixturevalue(which)
    got = metric_join.groups(docs, tau=tau).toPandas()
    assert dict(zip(got.doc_id, got.group_id)) == brute_groups(docs.toPandas(), tau)


def test_keep_one(odd):
    kept = metric_join.keep_one(odd)
    assert kept.columns == odd.columns
    gone = {d for d, g in brute_groups(odd.toPandas(), metric_join.TAU).items() if d != g}
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in odd_rows() if r[0] not in gone)


def leaks(frame, bench, n=fm_index.PHRASE_WORDS):
    grams = set()
    for t in bench:
        w = words.tokenize(pa.array([t], pa.string())).hash.tolist()
        if fm_index.MIN_PHRASE <= len(w) < n:
            grams.add(tuple(w))
        grams |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    out = set()
    sizes = {len(g) for g in grams}
    for d, t in zip(frame.doc_id, frame.text):
        if isinstance(t, str):
            w = words.tokenize(pa.array([t])).hash.tolist()
            if any(tuple(w[i : i + k]) in grams for k in sizes for i in range(len(w) - k + 1)):
                out.add(d)
    return out


@pytest.mark.parametrize("limit", [fm_index.PHRASE_BYTES, 4000])
def test_decontamination(spark, sf, table, limit):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    frame, items = table.toPandas(), bench.toPandas().text
    got = fm_index.leaks(table, bench, phrase_bytes=limit).toPandas()
    want = leaks(frame, items)
    assert set(got.doc_id) == want and want
    clean = fm_index.remove_leaks(table, bench, phrase_bytes=limit).toPandas()
    assert len(clean) == len(frame)
    left = clean.merge(frame, on="doc_id")
    assert set(left.doc_id[left.text_x != left.text_y]) == want
    assert (left.text_x.str.len() <= left.text_y.str.len()).all()


def test_decontamination_odd(spark, odd, empty):
    bench = spark.createDataFrame([(1, prose(2, 120)), (2, None), (3, ""), (4, "one"), (None, "x y z a b c")], "item_id long, text string")
    got = fm_index.leaks(odd, bench).toPandas()
    assert set(got.doc_id) == {4, 5}
    rows = {r.doc_id: r.text for r in fm_index.remove_leaks(odd, bench).collect()}
    assert rows[4].split() == (prose(4, 80) + " " + prose(5, 90)).split() and rows[6] is None and rows[7] == ""
    assert fm_index.leaks(empty, bench).count() == 0 and fm_index.leaks(odd, bench.limit(0)).count() == 0
    assert fm_index.remove_leaks(odd, bench.limit(0)).count() == odd.count()


def test_fm_index():
    r = np.random.default_rng(3)
    text = r.integers(1, 5, 300)
    index = fm_index.FMIndex(text)
    for k in (1, 2, 4):
        p = r.integers(1, 6, (20, k))
        low, high = index.search(p, np.full(20, k))
        for row, a, b in zip(p, low, high):
            want = [i for i in range(len(text) - k + 1) if (text[i : i + k] == row).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_licenses(spark, odd, empty):
    rows = [(1, prose(1, 50) + "\nReleased under the MIT License.\n" + prose(2, 30)), (2, "licensed under cc-by-nc 4.0"), (3, prose(3, 90)), (4, None), (5, ""), (6, "the License the License the License")]
    got = {(r.doc_id, r.template, r.start_word) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "mit-notice", 50), (2, "cc-by-nc-4.0-notice", 0)}
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0
    templates = spark.createDataFrame([("t", prose(2, 120)), ("n", None), (None, "a b c d")], "template string, text string")
    assert {r.doc_id for r in license_scan.scan(odd, templates).collect()} == {4, 5}


def test_license_occurrences_are_exact():
    r = random.Random(5)

    def common(x, y):
        row = [0] * (len(y) + 1)
        for u in x:
            last = row[:]
            for j, w in enumerate(y):
                row[j + 1] = last[j] + 1 if u == w else max(last[j + 1], row[j])
        return row[-1]

    hits = 0
    for _ in range(300):
        m, n = r.randint(4, 12), r.randint(4, 25)
        a, b = ([r.randint(0, 5) for _ in range(k)] for k in (n, m))
        if r.random() < 0.7:
            a[r.randint(0, n) :] = [x for x in b if r.random() < 0.95]
        span = int(m / 0.8)
        every = [(-k, e - s, s) for s in range(len(a)) for e in range(s + 1, min(len(a), s + span) + 1) if (k := common(a[s:e], b)) >= 0.8 * m - 1e-9]
        got = list(license_scan.occurrences(np.array(a), np.array(b), 0.8, 0, len(a)))
        assert bool(got) == bool(every)
        if got:
            hits += 1
            s, e, k = got[0]
            assert (-k, e - s, s) == min(every)
    assert hits > 50


def test_licenses_beside_their_own_words(spark):
    texts = dict(license_scan.TEMPLATES)
    gpl, cc0 = texts["gpl-3.0-notice"], texts["cc0-1.0-notice"]
    rows = [(1, "See the notes on this page before use. " + gpl + "."), (2, "Please refer to the notes below. " + cc0), (3, f"x {gpl} {gpl} y"), (4, "This is all that we say on it. That" + gpl[4:])]
    got = {(r.doc_id, r.template, r.start_word, r.end_word, r.coverage) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "gpl-3.0-notice", 8, 20, 1.0), (2, "cc0-1.0-notice", 6, 24, 1.0), (3, "gpl-3.0-notice", 1, 13, 1.0), (3, "gpl-3.0-notice", 13, 25, 1.0), (4, "gpl-3.0-notice", 9, 20, 0.916667)}


def test_whole_licenses_with_edits(spark):
    r = random.Random(2)
    names = ["mit", "bsd-2-clause", "bsd-3-clause", "isc", "apache-2.0", "mpl-2.0", "gpl-3.0", "lgpl-3.0", "gpl-3.0-header-full", "apache-2.0-header-full"]
    rows = []
    for n, name in enumerate(names):
        text = (license_scan.TEXTS / f"{name}.txt").read_text().split()
        rows.append((n, f"{prose(n, 40)} {' '.join(edited(r, text, 0.03))} {prose(90 + n, 40)}"))
    rows.append((50, f"{prose(50, 9)} All rights reserved. {prose(51, 9)}"))
    got = {(x.doc_id, x.template): x.coverage for x in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[n, name] > 0.93 for n, name in enumerate(names)) and got[50, "all-rights-reserved-notice"] == 1


def test_license_lines_of_the_table(table):
    frame = table.toPandas()
    want = set(frame.doc_id[frame.text.str.contains("Released under the MIT License|Licensed under CC BY-NC 4.0|GNU General Public License, version 3|Apache License, Version 2.0")])
    assert want <= set(license_scan.scan(table).toPandas().doc_id)


def test_packing(table, odd, empty):
    got = packing.assign(table, shard_bytes=40_000).toPandas()
    assert len(got) == table.count()
    for c in (got.groupby("shard").bytes.sum(), got.groupby("shard").tokens.sum(), got.groupby("shard").size()):
        assert c.max() <= 1.35 * c.mean()
    many = packing.assign(table, shard_bytes=10_000, block=4).toPandas()
    assert many["shard"].nunique() > 8 and len(many) == len(got)
    rows = packing.assign(odd).toPandas()
    assert len(rows) == len(odd_rows()) and rows.bytes.sum() == sum(len((r[1] or "").encode()) for r in odd_rows())
    assert packing.assign(empty).count() == 0


def test_packing_rule():
    bins = packing.pack(np.array([[0.9, 0.1, 0.1], [0.1, 0.9, 0.1], [0.1, 0.1, 0.9], [0.5, 0.5, 0.5]]), np.full((2, 3), 1.2))
    assert bins.tolist() == [0, 1, 0, 1]


@pytest.mark.parametrize("limit", [0, bpe.DICTIONARY_BYTES])
def test_bpe(spark, odd, empty, limit):
    import public_tokenizers
    import tiktoken

    v = queries.vocabulary(spark)
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k.encode("latin-1"): r for k, r in v.ranks.items()}, special_tokens={})
    extra = spark.createDataFrame([(90, "café    x\n\n  y 😀 <|endoftext|> " + "z" * 200, 3), (91, "ab" * 20_000 + " x", 3), (92, None, 3), (93, "", 3)], "doc_id long, text string, ids int")
    for docs in (odd, extra):
        for r in bpe.round_trip(docs, v, dictionary_bytes=limit).collect():
            assert r.exact and (r.ids is None if r.text is None else r.ids == coder.encode_ordinary(r.text))
    assert bpe.round_trip(empty, v, dictionary_bytes=limit).count() == 0


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = duck.execute(queries.ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)


@pytest.mark.parametrize("limit", [0, site_lines.BROADCAST_BYTES])
def test_lines(spark, odd, empty, limit):
    rows = [(i, f"menu\nbody {i}\n menu ", "a") for i in range(9)] + [(20, None, "a"), (21, "", "a"), (None, "menu", None), (22, "menu", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("site", F.lit(1))
    got = {r.doc_id: r.text for r in site_lines.drop_boilerplate(docs, broadcast_bytes=limit).collect()}
    assert got == {**{i: f"body {i}" for i in range(9)}, 20: None, 21: "", None: "menu", 22: "menu"}
    assert site_lines.drop_boilerplate(odd, broadcast_bytes=limit).columns == odd.columns
    assert site_lines.drop_boilerplate(odd, broadcast_bytes=limit).count() == odd.count()
    assert site_lines.drop_boilerplate(empty, broadcast_bytes=limit).count() == 0


def test_rules(odd, empty, table, spark, sf):
    got = cascade.judge(odd, flag="good")
    assert [r.good for r in got.where("doc_id in (6, 7, 8)").collect()] == [False] * 3
    assert cascade.judge(empty).count() == 0 and cascade.keep_good(odd).columns == odd.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    frame = cascade.judge(table).join(labels, "doc_id").toPandas()
    assert frame.keep[frame.quality == 1].all() and frame.keep[frame.quality == 0].mean() < 0.1
    order = cascade.measure(table)
    assert sorted(r.name for r, _, _ in order) == sorted(r.name for r in cascade.RULES)


def brute_pages(frame):
    """The same rule over a sorted list."""
    from urllib.parse import urlsplit

    rows = sorted((urlsplit(u).netloc, urlsplit(u).path, u, i, page_diff.text_lines(h)) for i, u, h in frame.itertuples(index=False))
    out = {}
    for n, (host, path, _, i, lines) in enumerate(rows):
        sides = [rows[k] if 0 <= k < len(rows) and rows[k][0] == host and rows[k][4] != lines else None for k in (n - 1, n + 1)]
        near = page_diff.nearest(path, *[s and (s[1], s[4], s[3]) for s in sides])
        a, b = lines, near[1] if near else []
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
        out[i] = (near and near[2], len(a), table[-1][-1])
    return out


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    got = page_diff.extract(pages.repartition(5)).toPandas()
    want = brute_pages(pages.toPandas())
    assert {r.page_id: (None if pd.isna(r.partner_id) else int(r.partner_id), r.lines, r.deleted) for r in got.itertuples()} == want


def test_pages_odd(spark):
    page = "<body><p>menu</p><p>text {}</p><p>end</p><script>x</script>"
    rows = [(1, "http://h/a/1", page.format(1)), (2, "http://h/a/2", page.format(2)), (3, "http://h/a/2b", page.format(2)), (4, "http://other/", page.format(4)), (5, None, page.format(5)), (6, "bad", None), (None, "http://x/", "<p>&lt;b&gt;")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "lines": F.lit(2)})
    got = {r.page_id: r.text for r in page_diff.extract(docs).collect()}
    assert got == {1: "text 1", 2: "text 2", 3: "menu\ntext 2\nend", 4: "menu\ntext 4\nend", 5: "menu\ntext 5\nend", 6: "", None: "<b>"}
    assert page_diff.extract(docs.limit(0)).count() == 0


def test_pages_past_equal_ones(spark, tmp_path):
    page = "<body><p>menu</p><p>text {}</p><p>end</p>"
    rows = [(n, f"http://h/a/{n // 3}?page={n}", page.format(n // 3)) for n in range(9)] + [(20, "http://i/", page.format(7)), (21, "http://i/b", page.format(7))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    docs.repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.partner_id, r.text) for r in queries.op10_html_extraction(spark, str(tmp_path)).collect()}
    assert {n: t for n, (_, t) in got.items()} == {**{n: f"text {n // 3}" for n in range(9)}, 20: "menu\ntext 7\nend", 21: "menu\ntext 7\nend"}
    assert [got[n][0] for n in range(9)] == [3] * 3 + [2] * 3 + [5] * 3


def test_bpe_words_are_laid_out_by_tasks(spark, table, monkeypatch):
    """The driver joins the bytes of ranges of words; it holds no table of them, and shares the ranks between runs."""
    v = queries.vocabulary(spark)
    monkeypatch.setattr(type(table), "toArrow", None)
    parts = dict(zip(bpe.LAYOUT, bpe.encoded_words(table, v)))
    h, count = np.frombuffer(parts["hash"], np.uint64), np.frombuffer(parts["count"], np.int32)
    n = bpe.counted_words(table).where(F.octet_length("word") <= bpe.LONG_WORD).count()
    assert len(h) == n > 0 and (h[1:] >= h[:-1]).all() and count.sum() * 4 == len(parts["ids"])
    assert all(r.exact for r in bpe.round_trip(table, v).select("exact").collect())


def test_bpe_cuts_words_as_the_pattern_does(spark, table, monkeypatch):
    """Texts are cut many at once, to the words that the pattern finds, without running it on each text."""
    r = random.Random(5)
    parts = ["'", "'s", "'re", "'ve", "'ll", "'l", "'r", "'S", *"stedm", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2028", *"éß日٣½5!?-", "\0", "😀", "\U0001d400", "\u0301", "\x1c", "\x85", "\u200b", "ab"]
    texts = [None, "", " ", "x's", "''s", "'sfoo", " 's", "'re", "'r", "a \n b", "a\u3000b", "a\u3000", *("".join(r.choices(parts, k=r.randrange(40))) for _ in range(5000))]
    want = [row.w for row in spark.createDataFrame([(t,) for t in texts], "text string").select(bpe.split_words(F.col("text")).alias("w")).collect()]
    for size in (len(texts), 700):  # also as slices of a larger array
        got = []
        for at in range(0, len(texts), size):
            found, ptr = bpe.cut(pa.array(texts).slice(at, size), np.frombuffer(bpe.classes(spark).value, np.uint8))
            found = found.to_pylist()
            got += [found[a:b] for a, b in zip(ptr[:-1], ptr[1:])]
        assert got == [w or [] for w in want]
    monkeypatch.setattr(bpe, "split_words", None)
    broken = spark.createDataFrame([(1, b"caf\xc3"), (2, b"\xa9 au lait"), (3, b"caf\xc3\xa9")], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    rows = {x.doc_id: x for x in bpe.round_trip(broken, queries.vocabulary(spark)).collect()}
    assert [rows[i].exact for i in (1, 2, 3)] == [False, False, True]
    rows = bpe.round_trip(table.where("doc_id % 10 = 0"), queries.vocabulary(spark), dictionary_bytes=20_000).select("doc_id", "ids", "exact")
    assert all(x.exact for x in rows.collect())


def test_bpe_codes_a_slice_at_a_time(spark, table, monkeypatch):
    """A worker holds the ids of one slice of a batch's texts, and of the dictionary no copy but of these texts' words."""
    import tracemalloc
    from types import SimpleNamespace

    v, kinds = queries.vocabulary(spark), bpe.classes(spark)
    data = bpe.encoded_words(table, v, limit=20_000)
    texts = pa.array([r.text for r in table.select("text").collect()] + [None, "", "ab" * 20_000 + " x", None])
    known = bpe._Dictionary(data)
    known.ids = np.concatenate((known.ids, np.zeros(1 << 23, np.int32)))
    tracemalloc.start()
    bpe._coded(texts.slice(0, 5), np.frombuffer(kinds.value, np.uint8), known, v.shared_ranks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < known.ids.nbytes / 2
    whole = bpe._coded(texts, np.frombuffer(kinds.value, np.uint8), known, v.shared_ranks).to_pylist()
    assert any(x and x["rare"] for x in whole)
    monkeypatch.setattr(bpe, "_dictionaries", {})
    monkeypatch.setattr(bpe, "CUT_BYTES", 5_000)
    read = []
    batches = (read.append(1) or texts.slice(a, n) for a, n in ((0, 50), (50, 0), (50, len(texts) - 50)))
    pieces = bpe._coder(SimpleNamespace(value=data), v.shared_ranks, kinds, "test").func(batches)
    first = next(pieces)
    assert 0 < len(first) < 50 and len(read) == 1
    # the numbers of a text's rare words may differ, but not the words
    named = lambda rows: [x and [x["rare"][-1 - p[0]] if p[0] < 0 else p for p in x["parts"]] for x in rows]
    assert named(first.to_pylist() + [x for piece in pieces for x in piece.to_pylist()]) == named(whole)


def test_empty_and_long(empty):
    assert collinear.repeated_passages(empty).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert metric_join.groups(empty).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    frame = docs.toPandas()
    good = cascade.keep_good(docs)
    lined = site_lines.drop_boilerplate(good)
    gone = {d for d, g in brute_groups(lined.toPandas(), metric_join.TAU).items() if d != g}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out.doc_id) == {r.doc_id for r in good.select("doc_id").collect()} - gone
    assert out.exact.all() and len(out) < len(frame)
    v = queries.vocabulary(spark)
    back = spark.createDataFrame([(int(d), [int(i) for i in x]) for d, x in zip(out.doc_id, out.ids)], "doc_id long, ids array<int>").select("doc_id", v.decode(F.col("ids")).alias("text")).toPandas()
    assert not leaks(back, bench.toPandas().text)


@pytest.mark.parametrize(("hot", "label_bytes", "few"), [(4, metric_join.LABEL_BYTES, 32), (metric_join.HOT, 0, 2), (metric_join.HOT, metric_join.LABEL_BYTES, 4)])
def test_jaccard_parted_sites_and_large_tables(spark, monkeypatch, hot, label_bytes, few):
    """Sites of near copies in parts, labels by a shuffle, new pivots: a chain of texts, of which only neighbours are near."""
    base = [f"c{i}" for i in range(60)]
    rows = [(100 + i, " ".join([*base[:40], *(f"n{i // 2}x{j}" for j in range(i % 3))])) for i in range(40)]
    rows += [(i, " ".join(f"c{j}" for j in range(6 * i, 6 * i + 60))) for i in range(12)] + [(i, prose(i, 60)) for i in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(metric_join, "ROOM_GUESTS", 5)
    monkeypatch.setattr(metric_join, "FEW", few)
    if few == 2:
        monkeypatch.setattr(metric_join, "EDGE_BYTES", 0)
    got = metric_join.groups(docs, hot=hot, label_bytes=label_bytes).toPandas()
    assert dict(zip(got.doc_id, got.group_id)) == brute_groups(docs.toPandas(), metric_join.TAU)


def brute_leaks(text, bench, n=fm_index.PHRASE_WORDS):
    """(items, byte spans, text) by comparing every window with every phrase."""
    w = words.tokenize(pa.array([text], pa.string()))
    own, cover, items = w.hash.tolist(), [False] * len(w.hash), set()
    for item, t in bench:
        g = words.tokenize(pa.array([t], pa.string())).hash.tolist()
        phrases = [g] if fm_index.MIN_PHRASE <= len(g) < n else [g[i : i + n] for i in range(len(g) - n + 1)]
        for p in phrases:
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    cover[i : i + len(p)] = [True] * len(p)
                    items.add(item)
    begins = [i for i, c in enumerate(cover) if c and (i == 0 or not cover[i - 1])]
    ends = [i + 1 for i, c in enumerate(cover) if c and (i + 1 == len(cover) or not cover[i + 1])]
    spans = [(int(w.start[a]), int(w.end[b - 1])) for a, b in zip(begins, ends)]
    data, out, at = text.encode(), b"", 0
    for a, b in spans:
        out, at = out + data[at:a], b
    return sorted(items), spans, (out + data[at:]).decode()


@pytest.mark.parametrize("limit", [fm_index.PHRASE_BYTES, 100])
def test_decontamination_spans_whatever_the_blocks(spark, limit):
    """Phrases that overlap, that a cut would put together, repeated and null ids, columns named like the result's."""
    r = random.Random(4)
    bench = [(1, "a1 b1 c1 d1 e1 f1 g1 h1"), (2, "x1 x2 x3 x4 x5 x6 x7 x8"), (3, "w5 w6 w7 w8 w9 w10 w11 w12"), (4, " ".join(f"w{i}" for i in range(1, 9))), (5, "k1 k2 k3 k4 k5")]
    texts = ["start x1 x2 x3 x4 a1 b1 c1 d1 e1 f1 g1 h1 x5 x6 x7 x8 end", "q " + " ".join(f"W{i}," for i in range(1, 13)) + " é", "k1 k2 k3 k4 k5 k1 k2 k3 k4 k5", "clean", "", None]
    texts += [" ".join(r.choice(["k1", "k2", "k3", "k4", "k5", "z"]) for _ in range(60)) for _ in range(20)]
    rows = [(1 if i < 2 else None if i == 2 else i, t, ["own"], 7, "b") for i, t in enumerate(texts)] + [(1, texts[0], ["own"], 7, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, items array<string>, begins int, ends string").repartition(2)
    tests = spark.createDataFrame(bench, "item_id long, text string")
    want = [(i, *brute_leaks(t, bench)) for i, t, *_ in rows if t]
    got = [(x.doc_id, x["items"], list(zip(x.begins, x.ends)), x.text) for x in fm_index.leaks(docs, tests, phrase_bytes=limit).collect()]
    assert sorted(map(repr, got)) == sorted(repr(x) for x in want if x[1])
    cut = fm_index.remove_leaks(docs, tests, phrase_bytes=limit)
    assert cut.columns == docs.columns
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, spark.createDataFrame([(i, t and brute_leaks(t, bench)[2], *rest) for i, t, *rest in rows], docs.schema).collect()))


def test_many_passages_of_two_long_texts(spark):
    shared = [prose(f"s{i}", 60) for i in range(1500)]
    a, b = (" ".join(f"{p} {' '.join(f'{side}{i}x{j}' for j in range(20))}" for i, p in enumerate(shared)) for side in "ab")
    got = collinear.repeated_passages(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert len(covered((x.doc_id, x.start_word, x.end_word) for x in got)) >= 0.98 * 1500 * 60


def test_frequent_seeds_go_to_other_tasks(spark):
    """A passage in more documents than one task may hold together: each but the first is still linked to an earlier one."""
    from loomtext.llm import packed, seeds

    p = prose("hot", 60)
    docs = spark.createDataFrame([(i, f"{prose(f'u{i}', 30)} {p} {prose(f'v{i}', 30)}") for i in range(60)], "doc_id long, text string").coalesce(2)
    links = seeds.links(docs, collinear.LONG_K, collinear.LONG_W, 4, hot=10)
    rows = [(int(d), int(h)) for r in links.collect() for d, h in zip(*packed.rows_of(r["block"])[1][:2])]
    assert {d for d, _ in rows} == set(range(1, 60)) and all(h < d for d, h in rows)


def test_pages_of_any_number_of_ranges(spark):
    """Runs of equal pages over several ranges, repeated keys with other texts, one host with nearly all pages, bounds anywhere."""
    page = lambda n: f"<body><p>menu</p><p>text {n}</p><p>end</p>"
    rows = [(n, f"http://h/a/{n:03d}", page(n // 9)) for n in range(60)] + [(100, "http://h/a/001", page("x")), (100, "http://h/a/001", page("y")), (101, "http://i/", page(1)), (102, None, None), (103, "http://j/1", page(2)), (104, "http://j/2", page(2))]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    outcomes = [sorted(map(repr, page_diff.extract(docs.repartition(3), past_equal=True, parts=n).collect())) for n in (1, 2, 5, 40)]
    assert all(o == outcomes[0] for o in outcomes) and len(outcomes[0]) == len(rows)
    got = {(r.page_id, r.url): r for r in page_diff.extract(docs, past_equal=True, parts=5).where("page_id < 60 or page_id > 100").collect()}
    assert all(got[n, f"http://h/a/{n:03d}"].text == f"text {n // 9}" for n in range(60))
    assert got[103, "http://j/1"].text == "menu\ntext 2\nend" and got[102, None].text == "" and got[101, "http://i/"].partner_id is None


def test_long_alignments_in_pieces(monkeypatch):
    r = random.Random(9)
    cases = [([r.randint(0, 9) for _ in range(r.randint(0, 60))], [r.randint(0, 9) for _ in range(r.randint(0, 60))]) for _ in range(60)]
    whole = [page_diff.shared_lines(a, b) for a, b in cases]
    monkeypatch.setattr(page_diff, "CELLS", 50)
    assert [page_diff.shared_lines(a, b) for a, b in cases] == whole
    for (a, b), at in zip(cases, whole):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for x in range(len(a)):
            for y in range(len(b)):
                table[x + 1][y + 1] = table[x][y] + 1 if a[x] == b[y] else max(table[x][y + 1], table[x + 1][y])
        rest = iter(b)
        assert len(at) == table[-1][-1] and all(a[i] in rest for i in at)


def test_page_texts(spark, sf):
    frame = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").toPandas()
    want = brute_pages(frame)
    html = dict(zip(frame.page_id, frame.html))
    for r in page_diff.extract(spark.createDataFrame(frame)).collect():
        lines, kept = page_diff.text_lines(html[r.page_id]), r.text.split("\n") if r.text else []
        rest = iter(lines)
        assert all(x in rest for x in kept) and len(kept) == len(lines) - want[r.page_id][2]


def plain_pack(vectors, bins, capacity):
    left, out = [[capacity] * 3 for _ in range(bins)], {}
    for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
        v = vectors[i]
        fits = [b for b in range(bins) if all(left[b][k] >= v[k] - 1e-12 for k in range(3))]
        if fits:
            best = max(fits, key=lambda b: (sum(x * y for x, y in zip(left[b], v)), -b))
        else:
            best = min(range(bins), key=lambda b: (max(max(v[k] - left[b][k], 0) for k in range(3)), b))
        out[i] = best
        left[best] = [x - y for x, y in zip(left[best], v)]
    return [out[i] for i in range(len(vectors))]


def test_packing_equals_a_plain_packer():
    r = np.random.default_rng(1)
    for _ in range(20):
        v = np.round(r.random((60, 3)) * r.choice([0.1, 0.3]), 2)
        v[10:20] = v[0]  # ties
        bins = max(1, int(np.ceil(v.sum(axis=0).max())))
        assert packing.pack(v, np.full((bins, 3), 1.02)).tolist() == plain_pack(v.tolist(), bins, 1.02)


def test_packing_as_a_tree_with_a_hot_source(spark):
    rows = [(i, prose(i % 50, 20 + i % 90), "hot" if i % 10 else f"s{i % 7}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = packing.assign(docs, shard_bytes=25_000, block=4, cells=64).toPandas()
    assert len(got) == 4000 and got.doc_id.is_unique
    for c in (got.groupby("shard").bytes.sum(), got.groupby("shard").tokens.sum(), got.groupby("shard").size()):
        assert len(c) > 4**2 and c.max() <= 1.35 * c.mean()
    again = packing.assign(docs.repartition(2), shard_bytes=25_000, block=4, cells=64).toPandas()
    assert dict(zip(again.doc_id, again["shard"])) == dict(zip(got.doc_id, got["shard"]))


def test_lines_trimmed(spark):
    docs = spark.createDataFrame([(i, f"menu\r\n0 body {i}\n\tmenu ", "a") for i in range(9)], "doc_id long, text string, source string")
    assert {r.text for r in site_lines.drop_boilerplate(docs).collect()} == {f"0 body {i}" for i in range(9)}
    # the place of a line has no part in what it is compared with
    docs = spark.createDataFrame([(i, f"x\n1 of all {i}", "a") for i in range(9)] + [(20, " of all 3", "a")], "doc_id long, text string, source string")
    assert site_lines.boilerplate(docs).count() == 1


def test_licenses_with_equal_choices(spark):
    notice = dict(license_scan.TEMPLATES)["mit-notice"]
    rows = [(1, f"{notice} {notice}"), (1, f"{notice} {notice}"), (2, notice.replace("the", "")), (None, notice)]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.coverage) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 5, 1.0), (1, 5, 10, 1.0)]


def test_pipeline_on_odd_tables(spark, sf, tmp_path):
    import shutil

    import corpus_pipeline

    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in out}
    assert all(r.exact for r in out) and 6 not in kept and 7 not in kept and {4, 13} <= kept
    # of the copies 1 (twice), 2 and 3 the rows of the first stay, and the one without an id
    assert sorted(str(r.doc_id) for r in out if r.doc_id in (None, 1, 2, 3)) == ["1", "1", "None"]
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_jaccard_writes_no_row_for_each_pair(spark, monkeypatch):
    """A cluster of n near documents is written as rows for documents and as a forest, once its pairs are counted."""
    n = 120
    docs = spark.createDataFrame([(i, " ".join(f"c{j}" for j in range(80) if j != i % 60) + f" own{i}") for i in range(n)], "doc_id long, text string").repartition(3)
    rows = collections.defaultdict(list)
    scratch = metric_join.scratch

    def counted(df, name):
        out = scratch(df, name)
        rows[name].append(out.count())
        return out

    monkeypatch.setattr(metric_join, "scratch", counted)
    got = metric_join.groups(docs).toPandas()
    assert set(got.links) == {n - 1} and set(got.group_id) == {0}
    assert rows["linked"] == [n] and max(rows["edges"]) < 4 * n


def test_packed_rows_are_folded_as_they_come(spark, monkeypatch):
    """A task that receives a key very often holds few rows at a time."""
    from loomtext.llm import packed

    seen = []

    def fold(key, columns):
        seen.append(len(key))
        key, at = np.unique(key, return_inverse=True)
        return key, [np.bincount(at, columns[0]).astype(np.int64)]

    key = np.arange(100, dtype=np.uint64) << np.uint64(50)
    monkeypatch.setattr(packed, "FLUSH_ROWS", 100)
    monkeypatch.setattr(packed, "FOLD_ROWS", 250)
    sent = pa.Table.from_batches(list(packed.sent(((key, [np.ones(100, np.int64)]) for _ in range(50)), 1))).to_batches()

    class Sent:
        """Stands for the table of blocks, so that the receiving function runs here."""

        sparkSession = spark

        def repartitionById(self, *_):  # noqa: N802
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            return list(run(iter(sent)))

    (got,) = packed.received(Sent(), lambda part, k, c: iter([(k, c)]), "x int", 1, fold)
    totals = fold(got[0], got[1])[1][0]
    assert set(totals) == {50} and max(seen) <= 500
