"""Exact substring dedup with suffix arrays by induced sorting.

Every run of ``min_words`` words that also occurs in a document of lower id is
found; the result is their union for each document, as (doc_id, start_word,
end_word), word offsets as in ``words``, ends exclusive.

A suffix array sees only its own shard, so the shards are made such that equal
passages meet: ``min_words``-word runs that two documents share have a common
minimizer seed; around its shared seeds each document is cut into regions, and
a region goes to the shard of the seeds' *hub*, the first document that has
them, as the hub's own region does.  What no other document shares is never
sorted.  A shard sorts the suffixes of its regions by induction, and computes
the permuted common prefixes; neighbours in the array with at least
``min_words`` in common are the occurrences of one run.  Regions with equal
words are sorted once, so that thousands of copies need no more memory than one.

Null ids or texts, texts of fewer words and empty tables give no rows; rows
that repeat a doc_id are the same document; repeats within one document only are
not reported; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm import seeds
from loomtext.llm.sais import common_prefixes, suffix_array

MIN_WORDS = 45
K = 12

#: Words after which a shard is sorted at the next change of hub.
SHARD_WORDS = 1 << 19


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals as disjoint ones in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _region_batches(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for hub, doc, pos, more in zip(batch["hub"].to_pylist(), batch["doc_id"].to_pylist(), batch["pos"], batch["more"]):
                at = np.concatenate((pos.values.to_numpy(), more.values.to_numpy())).astype(np.int64)
                lo, hi = _merge(np.maximum(at + k - length, 0), at + length)
                for column, values in zip(out, ([doc] * len(lo), lo.tolist(), hi.tolist(), [hub] * len(lo))):
                    column += values
            key = pa.StructArray.from_arrays([pa.array(out[3], pa.int64()), pa.array(out[0], pa.int64())], names=["hub", "doc"])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), key], names=["doc_id", "lo", "hi", "key"])

    return run


def repeats(docs: np.ndarray, regions: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each region, the starts of its runs of ``length`` words that a region of a lower document has too."""
    size = np.array([len(r) for r in regions])
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(begin[-1], np.int64)
    for i, (r, b) in enumerate(zip(regions, begin)):
        text[b : b + len(r)] = r
        text[b + len(r)] = (1 << 32) + i  # a border of its own, so that no run passes it
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa)[sa]
    group = np.flatnonzero(lcp < length)
    owner = np.repeat(np.asarray(docs), size + 1)[sa]
    least = np.minimum.reduceat(owner, group)
    flagged = sa[owner > np.repeat(least, np.diff(np.append(group, len(sa))))]
    flagged.sort()
    cut = np.searchsorted(flagged, begin)
    return [flagged[a:b] - s for a, b, s in zip(cut[:-1], cut[1:], begin)]


def _shard_batches(length: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        copies: dict[bytes, tuple[int, int]] = {}
        docs: list[int] = []
        bases: list[int] = []
        regions: list[np.ndarray] = []
        whole: list[tuple[int, int, int]] = []
        words, last = 0, None

        def flush() -> pa.RecordBatch:
            spans = [np.array(whole, np.int64).reshape(-1, 3)]
            if regions:
                for doc, base, starts in zip(docs, bases, repeats(np.array(docs), regions, length)):
                    lo, hi = _merge(starts, starts + length)
                    spans.append(np.stack((np.full(len(lo), doc), lo + base, hi + base), 1))
            rows = np.concatenate(spans)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32))], names=["doc_id", "start_word", "end_word"])

        for batch in batches:
            for hub, doc, lo, data in zip(batch["hub"].to_pylist(), batch["doc"].to_pylist(), batch["lo"].to_pylist(), batch["words"].to_pylist()):
                if hub != last and words >= shard_words:
                    yield flush()
                    copies, words = {}, 0
                    docs.clear(), bases.clear(), regions.clear(), whole.clear()
                last = hub
                n = len(data) // 4
                if n < length:
                    continue
                seen = copies.setdefault(data, (doc, lo))
                if seen[0] < doc:
                    whole.append((doc, lo, lo + n))
                elif seen == (doc, lo) or seen[0] > doc:
                    # lower documents come first within a hub, but hubs share a shard
                    copies[data] = (doc, lo)
                    docs.append(doc), bases.append(lo), regions.append(np.frombuffer(data, np.uint32))
                    words += n
                else:
                    docs.append(doc), bases.append(lo), regions.append(np.frombuffer(data, np.uint32))
                    words += n
        yield flush()

    return run


def _union_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, los, his = [], [], []
        for doc, at in zip(batch["doc_id"].to_pylist(), batch["at"]):
            lo, hi = _merge(at.values.field("start_word").to_numpy(), at.values.field("end_word").to_numpy())
            docs.append(np.full(len(lo), doc)), los.append(lo), his.append(hi)
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs, los, his)], names=["doc_id", "start_word", "end_word"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, k: int = K, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Spans of words that documents of lower id have too; see the module's docstring."""
    docs = seeds.base(docs, id_col, text_col)
    seen = seeds.shared(docs, k, min_words - k + 1)
    places = seen.groupBy("hub", "doc_id").agg(F.collect_list("pos").alias("pos"), F.flatten(F.collect_list("more")).alias("more"))
    requests = places.mapInArrow(_region_batches(min_words, k), "doc_id long, lo int, hi int, key struct<hub:long,doc:long>")
    found = seeds.segments(docs, requests).select("key.hub", "key.doc", "lo", "words")
    shards = found.repartition("hub").sortWithinPartitions("hub", "doc", "lo")
    spans = shards.mapInArrow(_shard_batches(min_words, shard_words), "doc_id long, start_word int, end_word int")
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("at")).mapInArrow(_union_batches, "doc_id long, start_word int, end_word int")
