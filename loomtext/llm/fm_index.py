"""Benchmark decontamination with an FM-index for each training shard.

Test items give phrases of ``phrase_words`` words (an item of fewer words is one
phrase, if it has at least ``min_phrase``).  A shard is a run of documents of
one task.  Its index is the Burrows-Wheeler transform of its words, from a
suffix array by induced sorting, with ranks by a wavelet matrix.  All phrases
are searched backwards at once; occurrences are located by walking back to
sampled suffix positions.  Overlapping and touching occurrences merge to
removal spans, and the text is cut out by byte offsets.

Words that no test item has cannot be part of a phrase, so a run of them is one
symbol in the index, and runs of test words too short for a phrase go the same
way: the index holds what could match, whatever the share of the corpus.

The phrases are broadcast in blocks of at most ``phrase_bytes`` each.  A task
holds one block at a time and searches all of them in the same original texts;
the spans of all are merged before anything is cut, so the size of a block has
no influence on the result.  Texts never shuffle.

A null text stays null, an empty one empty; null or empty items have no
phrases; repeated rows are treated alike and all kept; ids may be of any type.
``remove_leaks`` passes all other columns through, whatever their names;
``leaks`` reads none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.sais import suffix_array
from loomtext.llm.words import slices, tokenize

PHRASE_WORDS = 8
MIN_PHRASE = 5
PHRASE_BYTES = 64 << 20
#: Words of the index after which a shard is closed.
SHARD_WORDS = 1 << 18
SAMPLE = 8


class Wavelet:
    """Wavelet matrix: rank of any symbol before any place of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.start = np.searchsorted(values, np.arange(1 << self.levels)) if self.levels <= 20 else None
        self.sorted = values

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before place[i]."""
        begin = np.zeros(len(place), np.int64)
        for depth, level in enumerate(reversed(range(self.levels))):
            one = ((symbol >> level) & 1).astype(bool)
            ones = self.ones[depth]
            place = np.where(one, self.zeros[depth] + ones[place], place - ones[place])
            begin = np.where(one, self.zeros[depth] + ones[begin], begin - ones[begin])
        return place - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.int64)
        for depth in range(self.levels):
            ones = self.ones[depth]
            one = ones[place + 1] - ones[place]
            out = out << 1 | one
            place = np.where(one == 1, self.zeros[depth] + ones[place], place - ones[place])
        return out


class FMIndex:
    """Backward search and location over an array of symbols >= 1 (0 is the end)."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE) -> None:
        text = np.append(text, 0)
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text))))
        self.bwt = Wavelet(bwt)
        kept = sa % sample == 0
        self.kept = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.samples = sa[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase; a row of ``phrases`` is right-aligned."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        for step in range(width):
            live = np.flatnonzero((step < length) & (low < high))
            symbol = phrases[live, width - 1 - step]
            known = symbol < len(self.less) - 1
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            if len(live):
                low[live] = self.less[symbol] + self.bwt.rank(symbol, low[live])
                high[live] = self.less[symbol] + self.bwt.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        rows = rows.copy()
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            done = self.kept[r + 1] > self.kept[r]
            out[live[done]] = self.samples[self.kept[r[done]]] + steps[live[done]]
            live = live[~done]
            r = rows[live]
            symbol = self.bwt.access(r)
            rows[live] = self.less[symbol] + self.bwt.rank(symbol, r)
            steps[live] += 1
        return out


class Phrases:
    """The test phrases as rows of word numbers, with the items that have each."""

    def __init__(self, items: list[tuple[int, str]], words: int, least: int) -> None:
        self.owners: dict[tuple[int, ...], set[int]] = {}
        texts = tokenize(pa.array([t for _, t in items], pa.string()))
        for i, (item, _) in enumerate(items):
            own = texts.hash[texts.ptr[i] : texts.ptr[i + 1]].tolist()
            if least <= len(own) < words:
                self.owners.setdefault(tuple(own), set()).add(item)
            for j in range(len(own) - words + 1):
                self.owners.setdefault(tuple(own[j : j + words]), set()).add(item)
        keys = list(self.owners)
        self.items = [sorted(self.owners[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], np.int64)
        self.shortest = int(self.length.min()) if keys else 0
        width = int(self.length.max()) if keys else 0
        rows = np.zeros((len(keys), width), np.uint64)
        for r, k in zip(rows, keys):
            r[width - len(k) :] = k
        self.vocabulary = np.unique(np.array([w for k in keys for w in k], np.uint64))
        self.rows = np.searchsorted(self.vocabulary, rows) + 2
        del self.owners

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 2 on of test words, 1 of all others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


def _occurrences(phrases: Phrases, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of each occurrence in the symbols of a shard."""
    index = FMIndex(text)
    low, high = index.search(phrases.rows, phrases.length)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return index.locate(rows), which


def _reduced(numbers: np.ndarray, ptr: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols without what cannot match, and each one's word index."""
    n = len(numbers)
    test = numbers > 1
    border = np.zeros(n + 1, bool)
    border[ptr] = True
    first = np.flatnonzero(test & (border[:-1] | ~np.concatenate(([False], test[:-1]))))
    last = np.flatnonzero(test & (border[1:] | ~np.concatenate((test[1:], [False])))) + 1
    long = last - first >= shortest
    first, last = first[long], last[long]
    size = last - first + 1  # and a separator after each run
    total = int(size.sum())
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
    symbols = np.ones(total, np.int64)
    inner = np.ones(total, bool)
    inner[np.cumsum(size) - 1] = False
    symbols[inner] = numbers[at[inner]]
    return symbols, at


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of overlapping and touching intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _search_part(phrases: Phrases, held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]], text_col: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, set[int]]]]:
    """For each batch the rows that hold phrases, with the phrases' first words, last words and items."""
    text = np.concatenate([s for _, s, _ in held]) if held else np.zeros(0, np.int64)
    place, which = _occurrences(phrases, text) if len(text) else (np.zeros(0, np.int64),) * 2
    order = np.argsort(place, kind="stable")
    place, which = place[order], which[order]
    done = 0
    for batch, symbols, at in held:
        a, b = np.searchsorted(place, [done, done + len(symbols)])
        found = {}
        if a < b:
            word, phrase = at[place[a:b] - done], which[a:b]
            doc = np.searchsorted(tokenize(batch.column(text_col)).ptr, word, side="right") - 1
            for d in np.unique(doc).tolist():
                own = doc == d
                found[d] = word[own], word[own] + phrases.length[phrase[own]], {i for p in phrase[own].tolist() for i in phrases.items[p]}
        done += len(symbols)
        yield found


def _cut(text: str, begins: list[int], ends: list[int]) -> str:
    data, out, at = text.encode(), [], 0
    for b, e in zip(begins, ends):
        out.append(data[at:b])
        at = e
    return b"".join([*out, data[at:]]).decode()


def _scan(blocks: list, text_col: str, schema: pa.Schema, only_hits: bool):
    """``blocks``: broadcast phrases, all of which are searched in the texts as they are; with several, one is held at a time."""

    def loaded(block) -> Phrases:  # noqa: ANN001
        phrases = block.value
        if len(blocks) > 1:
            del block._value
        return phrases

    def symbols(phrases: Phrases, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words = tokenize(part.column(text_col))
        return _reduced(phrases.numbers(words.hash), words.ptr, phrases.shortest)

    def emit(held: list) -> Iterator[pa.RecordBatch]:
        every: list[dict] = [{} for _ in held]
        for n, block in enumerate(blocks):
            phrases = loaded(block)
            if n:
                held = [(part, *symbols(phrases, part)) for part, _, _ in held]
            for rows, found in zip(every, _search_part(phrases, held, text_col)):
                for d, new in found.items():
                    rows.setdefault(d, []).append(new)
            del phrases
        for (batch, _, _), rows in zip(held, every):
            hit = sorted(rows)
            text = batch.column(text_col)
            begins, ends, items = [], [], []
            if hit:
                words, values = tokenize(text), text.to_pylist()
                for d in hit:
                    lo, hi = spans(np.concatenate([x[0] for x in rows[d]]), np.concatenate([x[1] for x in rows[d]]))
                    begins.append(words.start[lo].tolist()), ends.append(words.end[hi - 1].tolist())
                    items.append(sorted(set().union(*(x[2] for x in rows[d]))))
                    values[d] = _cut(values[d], begins[-1], ends[-1])
                text = pa.array(values, text.type)
            new = {text_col: text}
            if only_hits:
                keep = pa.array(hit, pa.int64())
                batch, new = batch.take(keep), {text_col: text.take(keep), "begins": begins, "ends": ends, "items": items}
            columns = [pc.cast(new[f.name], f.type) if f.name == text_col else pa.array(new[f.name], f.type) if f.name in new else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = rows = 0
        first = blocks[0].value if len(blocks) == 1 else None
        for part in slices(batches, text_col):
            held.append((part, *(symbols(first or loaded(blocks[0]), part))))
            size, rows = size + len(held[-1][1]), rows + 1
            if size >= SHARD_WORDS or rows >= 64:
                yield from emit(held)
                held, size, rows = [], 0, 0
        yield from emit(held)

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in blocks of about ``limit`` bytes of phrases, one block in memory at a time."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).orderBy(item_col).toLocalIterator():
        block.append((item, text))
        size += 16 * len(text)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _phrases(benchmark: DataFrame, item_col: str, item_text: str, phrase_words: int, min_phrase: int, phrase_bytes: int) -> list:
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(p) for block in _blocks(benchmark, item_col, item_text, phrase_bytes) if (p := Phrases(block, phrase_words, min_phrase)).shortest]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", phrase_words: int = PHRASE_WORDS, min_phrase: int = MIN_PHRASE, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """(doc_id, items, begins, ends, text) of each row that holds a test phrase: item ids, byte spans, the text without them."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("items", "begins", "ends")), T.StructField("text", T.StringType())])
    blocks = _phrases(benchmark, item_col, item_text, phrase_words, min_phrase, phrase_bytes)
    return rows.mapInArrow(_scan(blocks, "text", _arrow(schema), True), schema) if blocks else docs.sparkSession.createDataFrame([], schema)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", phrase_words: int = PHRASE_WORDS, min_phrase: int = MIN_PHRASE, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """All rows and columns, the texts without test phrases."""
    blocks = _phrases(benchmark, item_col, item_text, phrase_words, min_phrase, phrase_bytes)
    return docs.mapInArrow(_scan(blocks, text_col, _arrow(docs.schema), False), docs.schema) if blocks else docs
