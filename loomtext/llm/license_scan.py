"""License scan by diagonal voting.

1. Every rolling word k-gram hash of every document is joined, in Spark, to the
   positions that hash has in the license templates.
2. Each match votes for its diagonal, document position less template
   position; votes are counted for each (document, template, diagonal).
3. Diagonals at most ``drift`` apart whose matches lie near each other are one
   occurrence, so that added or dropped words do not split it.
4. All windows of the words around an occurrence are compared with the template
   by longest common subsequence; those that have at least ``coverage`` of it in
   order on at most ``1 / coverage`` as many words are found, of overlapping
   ones the fullest, then the shortest.

Result: (doc_id, template, start_word, end_word, votes, coverage), word offsets
as in ``words``, ends exclusive.  Templates are a table (template, text); its
size decides whether Spark broadcasts it.  Templates of fewer than k words and
null ones have no k-grams and are never found.  Null ids or texts, empty texts
and empty tables give no rows; rows that repeat a doc_id give their findings
once; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm import seeds
from loomtext.llm.words import kgrams, slices, tokenize
from loomtext.runtime import scratch, table_bytes

K = 3
DRIFT = 4
COVERAGE = 0.9
#: k-grams of the templates that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("mit-notice", "Released under the MIT License"),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-notice", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0-1.0-notice", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("bsd-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl-3.0-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
    ("all-rights-reserved-notice", "All rights reserved"),
)

#: Whole licence texts and standard headers, a file for each template.
TEXTS = Path(__file__).parent / "licenses"


def default_templates(spark: SparkSession) -> DataFrame:
    """The notices above and all files of ``TEXTS``."""
    texts = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))]
    return spark.createDataFrame([*TEMPLATES, *texts], "template string, text string")


def _gram_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = tokenize(part.column("text"))
            g, ok = kgrams(words, k)
            count = np.maximum(np.diff(words.ptr) - k + 1, 0)
            offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(g[ok].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "grams"])

    return run


def _grams(rows: DataFrame, id_type: str, k: int) -> DataFrame:
    """(id, pos, h) of a table (id, text)."""
    return rows.mapInArrow(_gram_batches(k), f"id {id_type}, grams array<long>").select("id", F.posexplode("grams").alias("pos", "h"))


def _template_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = tokenize(part.column("text"))
        low = words.hash.astype(np.uint32)
        data = [low[a:b].tobytes() for a, b in zip(words.ptr[:-1], words.ptr[1:])]
        yield pa.RecordBatch.from_arrays([part.column("template"), pa.array(data, pa.binary())], names=["template", "model"])


def common_lengths(a: np.ndarray, b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequences of ``b`` and all windows of ``a``.

    Semi-local comparison by seaweed combing: strand v[j] ends at word j of
    ``a``, and the window [s, e) has e - s common words less the strands that
    both begin and end in it.  Cells of an anti-diagonal are independent.
    Returned are, for each s, the length for the window of ``span`` words, and
    where each strand begins.
    """
    m, n = len(b), len(a)
    # rows are kept in reverse, so that an anti-diagonal is a slice of both sides
    h, v, back = np.arange(m), np.arange(m, m + n), b[::-1]
    for d in range(m + n - 1):
        lo, hi = max(0, d - n + 1), min(m, d + 1)  # rows of the anti-diagonal; row i meets column d - i
        x, y = slice(m - hi, m - lo), slice(d - hi + 1, d - lo + 1)
        left, top = h[x], v[y]
        swap = (back[x] == a[y]) | (left > top)
        h[x], v[y] = np.where(swap, top, left), np.where(swap, left, top)
    begin = v - m
    size = np.minimum(span, n - np.arange(n))
    inner = np.array([np.count_nonzero(begin[s : s + k] >= s) for s, k in enumerate(size.tolist())], np.int64)
    return size - inner, begin


def occurrences(a: np.ndarray, b: np.ndarray, coverage: float, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, common words) of the disjoint places of ``b`` in ``a`` that meet the words from low to high.

    A place has at least ``coverage`` of b's words in order on at most
    ``1 / coverage`` as many; the fullest and shortest come first.
    """
    span = int(len(b) / coverage + 1e-9)
    length, begin = common_lengths(a, b, span)
    found = []
    for s in np.flatnonzero((length >= coverage * len(b) - 1e-9) & (np.arange(len(a)) < high)).tolist():
        k = min(span, len(a) - s)
        reached = np.arange(1, k + 1) - np.cumsum(begin[s : s + k] >= s)
        e = s + 1 + int(np.searchsorted(reached, length[s]))
        if e > low:
            found.append((-int(length[s]), e - s, s))
    taken: list[tuple[int, int]] = []
    for n, size, s in sorted(found):
        if all(s + size <= x or s >= y for x, y in taken):
            taken.append((s, s + size))
            yield s, s + size, -n


def _verify_batches(coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, name, votes, lo, low, high, data, model in zip(*(batch[c].to_pylist() for c in ("doc_id", "template", "votes", "lo", "low", "high", "words", "model"))):
                a, b = np.frombuffer(data, np.uint32), np.frombuffer(model, np.uint32)
                for start, end, n in occurrences(a, b, coverage, low - lo, high - lo):
                    rows.append((doc, name, lo + start, lo + end, votes, round(n / len(b), 6)))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "template", "start_word", "end_word", "votes", "coverage"])

    return run


def _apart_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of findings that overlap, the fullest, then the shortest, then the first."""
    for batch in batches:
        rows = []
        for doc, name, found in zip(*(batch[c].to_pylist() for c in ("doc_id", "template", "found"))):
            taken: list[dict] = []
            for x in sorted(found, key=lambda x: (-x["coverage"], x["end_word"] - x["start_word"], x["start_word"], -x["votes"])):
                if all(x["end_word"] <= y["start_word"] or x["start_word"] >= y["end_word"] for y in taken):
                    taken.append(x)
            rows += [(doc, name, x["start_word"], x["end_word"], x["votes"], x["coverage"]) for x in taken]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.float64()]
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["doc_id", "template", "start_word", "end_word", "votes", "coverage"])


def scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", k: int = K, drift: int = DRIFT, coverage: float = COVERAGE) -> DataFrame:
    """Occurrences of the templates; see the module's docstring."""
    docs = seeds.base(docs, id_col, text_col)
    models = (default_templates(docs.sparkSession) if templates is None else templates).select(F.col("template").cast("string"), "text").where("template is not null and text is not null")
    places = _grams(models.select(F.col("template").alias("id"), "text"), "string", k).select(F.col("id").alias("template"), F.col("pos").alias("tpos"), "h")
    places = scratch(places, "places")
    if table_bytes(places) <= BROADCAST_BYTES:
        places = F.broadcast(places)
    votes = (
        _grams(docs.select(F.col("doc_id").alias("id"), "text"), "long", k)
        .join(places, "h")
        .groupBy(F.col("id").alias("doc_id"), "template", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.count_distinct("pos").alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    )
    # neighbouring diagonals, in order; one that is further off, or whose matches lie elsewhere, begins an occurrence
    order = Window.partitionBy("doc_id", "template").orderBy("diagonal")
    size = places.groupBy("template").agg((F.max("tpos") + k).alias("length"))
    sized = votes.join(size, "template")
    begins = sized.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > drift, F.lit(True)).cast("int"))
    merged = begins.withColumn("no", F.sum("new").over(order)).groupBy("doc_id", "template", "no", "length").agg(F.sum("votes").alias("votes"), F.min("low").alias("low"), (F.max("high") + k).alias("high"))
    # even with one word in k replaced, some of the k-grams of a covered template are left
    likely = merged.where(F.col("votes") * 3 * k >= F.col("length") - k + 1)
    key = F.struct("template", "doc_id", "votes", "no", "low", "high").alias("key")
    reach = F.ceil(F.col("length") / F.lit(coverage))
    requests = likely.select("doc_id", (F.col("low") - reach).cast("int").alias("lo"), (F.col("high") + reach).cast("int").alias("hi"), key)
    found = seeds.segments(docs, requests, compact=True).select("key.*", "lo", "words")
    words = models.mapInArrow(_template_words, "template string, model binary")
    schema = "doc_id long, template string, start_word int, end_word int, votes long, coverage double"
    each = found.join(words, "template").mapInArrow(_verify_batches(coverage), schema).groupBy("doc_id", "template")
    return each.agg(F.collect_list(F.struct("start_word", "end_word", "votes", "coverage")).alias("found")).mapInArrow(_apart_batches, schema)
