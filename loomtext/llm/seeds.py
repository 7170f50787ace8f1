"""Minimizer seeds shared between documents, and the word segments around them.

Equal runs of ``k + w - 1`` words always select the same k-gram, so every
passage that long which two documents share is found through a common seed.
For ``shared`` each occurrence of a seed goes to its *hub*, the document of
lowest id that has it: rows grow with the text, not with the square of the
number of copies, and no occurrence is left out however frequent a seed is.

Rows whose doc_id is null take no part.  Rows that repeat a doc_id count as the
same document.  A null or empty text has no words and so no seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm import packed
from loomtext.llm.words import kgrams, minimizers, mix64, slices, tokenize
from loomtext.runtime import scratch, small

#: Requests for segments of one document that are served by one pass over its text.
REQUESTS_AT_ONCE = 4096
#: Documents with one seed in one task beyond which they are spread, and bytes of requests that are broadcast.
HOT = 4096
BROADCAST_BYTES = 16 << 20
#: Bits of a cell's number in the table of frequent seeds, of which each cell is one bit.
CELL_BITS = 26


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that the search needs, whatever else the table holds; ids are numbers of at most 64 bits."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")


def _seed_batches(k: int, w: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = tokenize(part.column("text"))
            at, h = minimizers(words, k, w)
            if not len(at):
                continue
            doc = np.searchsorted(words.ptr, at, side="right") - 1
            pos = (at - words.ptr[doc]).astype(np.int32)
            order = np.lexsort((pos, h, doc))
            doc, pos, h = doc[order], pos[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            more = np.diff(np.append(first, len(h))) - 1
            rest = pa.array(pos[~new], pa.int32())
            offsets = np.concatenate(([0], np.cumsum(more))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(more == 0, False)), rest)
            ids = part.column("doc_id").take(pa.array(doc[first]))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), ids, pa.array(pos[first]), lists], names=["h", "doc_id", "pos", "more"])

    return run


def seeds(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(h, doc_id, pos, more): a seed once per document, with its first word position and the later ones."""
    return docs.mapInArrow(_seed_batches(k, w), "h long, doc_id long, pos int, more array<int>")


def shared(docs: DataFrame, k: int, w: int) -> DataFrame:
    """(hub, doc_id, pos, more): every occurrence of the seeds that more than one document has, the hub's own too."""
    within = Window.partitionBy("h").orderBy("doc_id")
    rows = seeds(docs, k, w).withColumns({"hub": F.first("doc_id").over(within), "next": F.lead("doc_id").over(within)})
    return rows.where("hub <> doc_id or next is not null").select("hub", "doc_id", "pos", "more")


def _spread(key: np.ndarray, columns: list[np.ndarray], partners: int, hot: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a seed that more than ``hot`` documents here have, all but the first go to other tasks, and the first document to each of these."""
    doc, pos = columns
    entry = np.ones(len(key), bool)
    entry[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.concatenate(([True], key[1:] != key[:-1]))
    number = np.cumsum(entry) - 1
    begin = np.maximum.accumulate(np.where(first, number, 0))
    size = np.bincount(np.cumsum(first) - 1, entry)[np.cumsum(first) - 1]
    rank = number - begin
    many = size > hot
    if not many.any():
        return key, columns
    salts = np.uint64(64)
    salt = np.where(many & (rank > partners), mix64(doc.view(np.uint64)) % salts + np.uint64(1), 0).astype(np.uint64)
    again = np.flatnonzero(many & (rank == 0))
    copies = np.repeat(again, int(salts))
    key = np.concatenate((packed.salted(key, salt), packed.salted(key[copies], np.tile(np.arange(1, int(salts) + 1, dtype=np.uint64), len(again)))))
    doc, pos = np.concatenate((doc, doc[copies])), np.concatenate((pos, pos[copies]))
    order = np.lexsort((doc, key))
    return key[order], [doc[order], pos[order]]


def _seed_blocks(k: int, w: int, partners: int, hot: int, parts: int):
    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        for part in slices(batches):
            words = tokenize(part.column("text"))
            at, h = minimizers(words, k, w)
            doc = np.searchsorted(words.ptr, at, side="right") - 1
            yield packed.salted(h, np.zeros(len(h))), [part.column("doc_id").to_numpy()[doc], at - words.ptr[doc]]

    return lambda batches: packed.sent(tables(batches), parts, lambda key, columns: _spread(key, columns, partners, hot))


def linked(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, partners: int) -> Iterator[list[np.ndarray]]:
    """(doc, hub, pos, hpos) of the occurrences of seeds, sorted by (seed, document), some at a time."""
    order = np.lexsort((pos, doc, key))
    key, doc, pos = key[order], doc[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])  # rows that repeat an id
    key, doc, pos = key[new], doc[new], pos[new]
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(start, len(key)))
    seed = key[start]
    first = np.concatenate(([True], seed[1:] != seed[:-1]))
    number = np.arange(len(start))
    rank = number - np.maximum.accumulate(np.where(first, number, 0))
    n = np.where((rank > partners) | ((seed & np.uint64(0xFFFF)) > 0), np.minimum(rank, 1), rank)
    total = np.cumsum(n * count)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + packed.FLUSH_ROWS // 4, side="right")))
        own = np.repeat(np.arange(a, b), n[a:b])
        other = own - rank[own] + np.arange(len(own)) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        size = count[own]
        i = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own, other = np.repeat(own, size), np.repeat(other, size)
        yield [doc[start[own]], doc[start[other]], pos[start[own] + i], pos[start[other] + np.minimum(i, count[other] - 1)]]
        a = b


def _frequent(key: np.ndarray, doc: np.ndarray, partners: int) -> np.ndarray:
    """The seeds, sorted by (seed, document), of which ``linked`` passes over pairs of documents."""
    entry = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
    seed, count = np.unique(key[entry], return_counts=True)
    return seed[(count > partners + 1) | ((seed & np.uint64(0xFFFF)) > 0)]


def _receive_links(partners: int, ends: tuple[int, ...], parts: int, tell: bool):
    def receive(part: int, key: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        def tables() -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
            for doc, hub, pos, hpos in linked(key, *columns, partners):
                for step in ends:
                    yield packed.salted(mix64(doc.view(np.uint64)), np.zeros(len(doc))), [doc, hub, pos + step, hpos + step]

        if tell:
            many = _frequent(key, columns[0], partners)
            if len(many):
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([packed.block(many, [])], pa.binary())], names=["part", "block"])
        yield from packed.sent(tables(), parts)

    return receive


def links(docs: DataFrame, k: int, w: int, partners: int, ends: tuple[int, ...] = (0,), hot: int = HOT) -> DataFrame:
    """Blocks, by document, of (doc, hub, pos, hpos) for each occurrence of a seed and the documents of lower id that have it.

    The first ``partners`` + 1 documents of a seed are linked to all before
    them, the later ones of a frequent seed to the first document only; where
    one task alone meets more than ``hot`` documents with a seed, to one of the
    first.  The i-th occurrence within a document goes with the other's i-th,
    or its last.  Each is given at all of ``ends`` from its beginning.
    """
    parts = packed.part_count(docs)
    return packed.exchange(docs, _seed_blocks(k, w, partners, hot, parts), _receive_links(partners, ends, parts, False), packed.BLOCKS, 2)


def _window_blocks(k: int, w: int, n: int, table, hot: int, parts: int):  # noqa: ANN001
    """The runs of ``n`` words that hold a frequent seed, wherever in the run it stands."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        bits = table.value
        for part in slices(batches):
            words = tokenize(part.column("text"))
            at, h = minimizers(words, k, w)
            cell = (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            at = at[bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 > 0]
            if not len(at):
                continue
            turn = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(turn, np.maximum(at - (n - k), 0), 1)
            np.add.at(turn, at + 1, -1)
            g, ok = kgrams(words, n)
            begin = np.flatnonzero((np.cumsum(turn[:-1]) > 0) & ok)
            doc = np.searchsorted(words.ptr, begin, side="right") - 1
            yield packed.salted(g[begin], np.zeros(len(begin))), [part.column("doc_id").to_numpy()[doc], begin - words.ptr[doc]]

    return lambda batches: packed.sent(tables(batches), parts, lambda key, columns: _spread(key, columns, 0, hot))


def complete_links(docs: DataFrame, k: int, w: int, partners: int, n: int, inner: int, hot: int = HOT) -> DataFrame:
    """``links``, and for each run of ``n`` words that holds a frequent seed those of the run itself.

    What a frequent seed's links leave out is so made up for: the documents
    with one run of ``n`` >= k + w - 1 words are a class, and each is linked to
    its first (beyond ``hot`` in one task, to one of the first).  Their number
    grows with the text, not with the pairs.  Links are given at both ends of
    a seed or run and at steps of at most ``k`` between them, at which ``inner``
    words match.
    """
    parts = packed.part_count(docs)
    all_of = lambda size: (*range(0, size - inner, k), size - inner)
    own = scratch(packed.exchange(docs, _seed_blocks(k, w, partners, hot, parts), _receive_links(partners, all_of(k), parts, True), packed.BLOCKS, 2), "links")
    bits = np.zeros(1 << CELL_BITS - 3, np.uint8)
    for row in own.where("part < 0").select("block").toLocalIterator():
        cell = (packed.rows_of(row["block"])[0] >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, cell >> 3, (1 << (cell & 7)).astype(np.uint8))
    own = own.where("part >= 0")
    if not bits.any():
        return own
    table = docs.sparkSession.sparkContext.broadcast(bits)
    return own.unionByName(packed.exchange(docs, _window_blocks(k, w, n, table, hot, parts), _receive_links(0, all_of(n), parts, False), packed.BLOCKS, 2))


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words = tokenize(part.column("text"))
        low = words.hash.astype(np.uint32)
        wanted = part.column("wanted")
        flat = wanted.flatten()
        count = np.diff(wanted.offsets.to_numpy(zero_copy_only=False))
        doc = np.repeat(np.arange(part.num_rows), count)
        size = np.diff(words.ptr)[doc]
        lo = np.clip(flat.field("lo").to_numpy(zero_copy_only=False), 0, size).astype(np.int64)
        hi = np.clip(flat.field("hi").to_numpy(zero_copy_only=False), lo, size).astype(np.int64)
        begin, length = words.ptr[doc] + lo, hi - lo
        ends = np.cumsum(length)
        # segments are cut into batches, so that many requests for one text do not pile up
        first = 0
        while first < len(doc):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + (1 << 20), side="right")))
            n = length[first:last]
            index = np.repeat(begin[first:last] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            offsets = pa.py_buffer(np.concatenate(([0], np.cumsum(n * 4))).astype(np.int32).tobytes())
            data = pa.Array.from_buffers(pa.binary(), last - first, [None, offsets, pa.py_buffer(low[index].tobytes())])
            yield pa.RecordBatch.from_arrays([flat.field("key").slice(first, last - first), pa.array(lo[first:last].astype(np.int32)), data], names=["key", "lo", "words"])
            first = last


def segments(docs: DataFrame, requests: DataFrame, compact: bool = False) -> DataFrame:
    """(key, lo, words) for each request (doc_id, lo, hi, key): 32-bit hashes of the words from lo to hi.

    One shuffle of the requests and one of the texts that are asked for; a
    document with very many requests is read once for each 4096 of them.  With
    ``compact`` the requests are written first, and few go to the texts instead.
    """
    order = Window.partitionBy("doc_id").orderBy("lo", "hi")
    grouped = requests.withColumn("n", F.floor((F.row_number().over(order) - 1) / REQUESTS_AT_ONCE)).groupBy("doc_id", "n").agg(F.collect_list(F.struct("lo", "hi", "key")).alias("wanted"))
    if compact:
        grouped = small(scratch(grouped, "requests"), BROADCAST_BYTES)
    joined = docs.join(grouped, "doc_id").select("text", "wanted")
    key = requests.schema["key"].dataType.simpleString()
    return joined.mapInArrow(_segment_batches, f"key {key}, lo int, words binary")

