"""Byte-level BPE encoding and decoding with a public vocabulary.

Encoding: texts are cut to words as the vocabulary's pattern does, from the
classes of their characters, many texts at once; Spark's own regular expressions
give the class of each code point.  Distinct words
are counted over the whole corpus, and the most frequent ones, as many as
``dictionary_bytes`` hold, are encoded once: a Spark ``aggregate`` folds merges
over the array of a word's bytes, at each step joining the neighbours of lowest
rank, with the ranks in a literal map (two places by hash, so that a lookup
takes one step).  Bytes are kept as characters U+0000 to U+00FF.  The encoded
words are hashed, sorted and laid out by tasks, so that the driver only joins
their bytes, and travel to the tasks, where texts take their ids from them without a
shuffle of the corpus; the distinct words of a text that are not among them are
folded there by the same expression, and stand between runs of the others' ids.
So the limit moves work only.

Decoding: the pieces of the ids are joined to one byte string, which is UTF-8.

A null text has null ids; an empty one has none.  Strings that look like
special tokens are ordinary text.  Repeated rows are all kept; further columns
pass through, and a column named like a new one is replaced.  The fold takes the
square of a word's length; words of more than ``LONG_WORD`` bytes, which are no
words of a language, are merged by the same ranks from a heap, to the same ids.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import packed
from loomtext.llm.words import _buffers, _power_tables, mix64, slices
from loomtext.runtime import release, scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Java spelling of the vocabulary's pattern; (?U) makes \s as wide as elsewhere.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Of the literal map, at least; more for larger vocabularies.
SLOTS = 1 << 17
NONE = 2147483647
SHIFT = 1 << 31
DICTIONARY_BYTES = 48 << 20
LONG_WORD = 1 << 10
#: Bytes of text that are cut, bytes of words that are counted, and bytes that are hashed, at once.
CUT_BYTES = 1 << 21
COUNTED_BYTES = 1 << 24
HASHED_BYTES = 1 << 18
#: Classes of characters.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Ranges of hashes in which the encoded words come to the driver, one after the other.
RANGES = 16
LAYOUT = ["hash", "word", "length", "ids", "count"]


def load_ranks(path: str = VOCABULARY) -> dict[str, int]:
    """Pieces, each byte a character, with their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _cuckoo(places: list[tuple[int, int]], size: int) -> list[int]:
    """Slots such that each key, by its number, is in one of its two places."""
    slots = [-1] * size
    for key in range(len(places)):
        at, now = places[key][0], key
        for _ in range(10_000):
            slots[at], now = now, slots[at]
            if now < 0:
                break
            one, two = places[now]
            at = two if at == one else one
        else:
            raise ValueError("the vocabulary needs more slots")
    return slots


class Vocabulary:
    """Literal columns of a vocabulary for one session.

    Spark looks a key up in its own maps by going through all of them; the
    literal map here is an array of slots, in which a piece is at one of the two
    places that its hashes give, and the array of the pieces it is compared with.
    """

    def __init__(self, spark: SparkSession, ranks: dict[str, int]) -> None:
        self.ranks = ranks
        self.shared_ranks = spark.sparkContext.broadcast(ranks)
        self.slots = SLOTS
        while self.slots < 3 * len(ranks):
            self.slots *= 2
        pieces = [""] * (max(ranks.values(), default=-1) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        rows = spark.createDataFrame(list(enumerate(pieces)), "rank int, piece string").select("rank", *self._places(F.col("piece"))).collect()
        places = [(0, 0)] * len(pieces)
        for rank, one, two in rows:
            places[rank] = (one, two)
        text = json.dumps({"s": _cuckoo(places, self.slots), "p": pieces})
        self._tables = F.from_json(F.lit(text), "struct<s:array<int>,p:array<string>>")
        self._pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")

    def _places(self, piece: Column) -> tuple[Column, Column]:
        return tuple(F.pmod(h, F.lit(self.slots)).cast("int") for h in (F.xxhash64(piece), F.xxhash64(F.lit(7), piece)))

    def fold(self, word: Column) -> Column:
        """Ids of one word, by folding merges over its bytes."""
        let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
        return let(self._tables, lambda tables: let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), lambda text: self._fold(tables, text, let)))

    def _fold(self, tables: Column, text: Column, let) -> Column:  # noqa: ANN001
        """The state is the places between pieces, each with the rank that joining there would give in its upper bits; at the ends, where nothing joins, NONE."""
        either = lambda test, yes, no: F.call_function("if", test, yes, no)
        place = lambda x: (x % F.lit(SHIFT)).cast("int")
        size = F.length(text)
        end = lambda at: at.cast("long") + F.lit(NONE * SHIFT)

        def rank(piece: Column) -> Column:
            """The rank of a piece, NONE if the vocabulary lacks it."""
            fits = lambda x, own: F.get(tables["p"], x).eqNullSafe(own)
            slot = lambda own, which: F.get(tables["s"], self._places(own)[which])
            second = lambda own: let(slot(own, 1), lambda y: either(fits(y, own), y, F.lit(NONE)))
            return let(piece, lambda own: let(slot(own, 0), lambda x: either(fits(x, own), x, second(own))))

        def merge(state: Column, best: Column) -> Column:
            def joined(rest: Column, i: Column) -> Column:
                """``i`` is the index that is gone; what joins on either side of it has a new rank."""
                at = lambda j: place(F.get(rest, j))
                entry = lambda x, j: rank(let(at(j - 1), lambda low: F.substr(text, low + 1, at(j + 1) - low))).cast("long") * F.lit(SHIFT) + place(x)
                first = F.greatest(i - 1, F.lit(1))
                sides = let(first, lambda low: F.transform(F.slice(rest, low + 1, F.least(i, F.size(rest) - 2) - low + 1), lambda x, k: entry(x, low + k)))
                return F.concat(F.slice(rest, F.lit(1), first), sides, F.slice(rest, F.least(i, F.size(rest) - 2) + 2, F.size(rest)))

            whole = lambda i: let(F.array_remove(state, best), lambda rest: either(F.size(rest) == 2, rest, joined(rest, i)))
            return let(F.array_position(state, best).cast("int") - 1, whole)

        inner = F.transform(F.sequence(F.lit(1), size - 1), lambda i: rank(F.substr(text, i, F.lit(2))).cast("long") * F.lit(SHIFT) + i)
        start = F.concat(F.array(end(F.lit(0))), inner, F.array(end(size)))
        step = lambda state, _: let(F.array_min(state), lambda best: either(best < NONE * SHIFT, merge(state, best), state))
        cuts = lambda state: F.transform(state, place)
        ids = lambda at: F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda k: rank(F.substr(text, F.get(at, k - 1) + 1, F.get(at, k) - F.get(at, k - 1))))
        folded = let(cuts(F.aggregate(F.sequence(F.lit(2), size), start, step)), ids)
        # a word that is a piece needs no merges
        return let(rank(text), lambda own: either(own != NONE, F.array(own), folded))

    def decode(self, ids: Column) -> Column:
        """The text of an array of ids."""
        joined = F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i)), "")
        return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")


def merge_bytes(word: str, ranks: dict[str, int]) -> list[int]:
    """Ids of a very long word; a heap keeps it from taking the square of its length."""
    import heapq

    text = word.encode().decode("latin-1")
    if text in ranks:
        return [ranks[text]]
    n = len(text)
    piece, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, text[i : i + 2]) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if not piece[i] or j >= n or piece[i] + piece[j] != both:
            continue
        piece[i], piece[j], after[i] = both, "", after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(both + piece[after[j]])) is not None:
                heapq.heappush(heap, (r, i, both + piece[after[j]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i]] + both)) is not None:
            heapq.heappush(heap, (r, before[i], piece[before[i]] + both))
    return [ranks[p] for p in piece if p]


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


_classes: dict[str, Broadcast] = {}


def classes(spark: SparkSession) -> Broadcast:
    """The class of each code point as the pattern sees it, for one session; surrogates are no characters."""
    app = spark.sparkContext.applicationId
    if app not in _classes:
        step = 1 << 12
        chars = [(a, "".join(map(chr, range(a, a + step)))) for a in range(0, 0x110000, step) if not 0xD800 <= a < 0xE000]
        text = F.col("text")
        for kind, one in ((r"[^\s\p{L}\p{N}]", "!"), (r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
            text = F.regexp_replace(text, "(?U)" + kind, one)
        table = np.full(0x110000, OTHER, np.uint8)
        for a, kinds in spark.createDataFrame(chars, "at int, text string").select("at", text).collect():
            table[a : a + step] = [" a0!".index(c) for c in kinds]
        _classes[app] = spark.sparkContext.broadcast(table.tobytes())
    return _classes[app]


def _kinds(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each byte's character, in valid UTF-8."""
    kinds = table[:256][data]
    at = np.flatnonzero(data >= 0xC0)
    more = (data[at] >= 0xE0).astype(np.int8) + (data[at] >= 0xF0) + 1
    for k in (1, 2, 3):
        lead = at[more == k]
        point = (data[lead] & (0x3F >> k)).astype(np.int32)
        for j in range(1, k + 1):
            point = point << 6 | data[lead + j] & 0x3F
        kind = table[point]
        for j in range(k + 1):
            kinds[lead + j] = kind
    return kinds


def cut(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts as ``PATTERN`` finds them, and where each text's begin."""
    texts = texts.fill_null("") if texts.null_count else texts
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    data, off = _buffers(texts)
    n = len(data)
    if not n:
        return pa.array([], pa.string()), np.zeros(len(off), np.int64)
    kinds = _kinds(data, table)
    border = np.zeros(n + 1, bool)
    border[off] = True
    change = border[:-1].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    first = np.flatnonzero(change)
    last = np.append(first[1:], n)
    kind = kinds[first]
    start = np.zeros(n + 1, bool)
    # a run of blanks is one word; before another word its last one goes with that, or is its own if it is no space
    blank = kind == SPACE
    start[first[blank]] = True
    end = last[blank]
    end = end[~border[end]] - 1
    for _ in range(3):
        end -= (data[end] & 0xC0) == 0x80
    start[end] = True
    # any other run is one word, with the space before it
    run = first[~blank]
    spaced = ~border[run] & (data[run - 1] == 0x20)
    start[run - spaced] = True
    # an apostrophe alone takes the letters of a contraction
    mark = run[~spaced & (data[run] == 0x27) & (last[~blank] == run + 1)] + 1
    mark = mark[~border[mark]]
    one, two = data[mark], data[np.minimum(mark + 1, n - 1)]
    is_one, is_two = np.isin(one, list(b"stmd")), ((two == ord("e")) & np.isin(one, list(b"rv")) | (two == ord("l")) & (one == ord("l"))) & ~border[np.minimum(mark + 1, n)]
    start[mark[is_one | is_two]] = False
    start[np.concatenate((mark[is_one] + 1, mark[is_two] + 2))] = True
    at = np.flatnonzero(start[:n])
    ends = np.append(at, n).astype(np.int32 if n <= 2147483647 else np.int64)
    return pa.Array.from_buffers(pa.string() if ends.dtype == np.int32 else pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(at, off)


def _counter(table: Broadcast):  # noqa: ANN202
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.frombuffer(table.value, np.uint8)
        held: list[pa.Array] = []
        size = 0

        def flush() -> pa.RecordBatch:
            found = pc.value_counts(pa.chunked_array(held, pa.string()))
            held.clear()
            return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

        for part in slices(batches, "text", CUT_BYTES):
            texts = part.column("text")
            held.append(cut(texts, kinds)[0].cast(pa.string()))
            size += len(_buffers(texts)[0])
            if size >= COUNTED_BYTES:
                yield flush()
                size = 0
        if held:
            yield flush()
        packed.give_back()

    return counted


def counted_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all distinct words of the corpus."""
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(classes(docs.sparkSession)), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def frequent(words: DataFrame, cost: Column, limit: int) -> DataFrame:
    """The words of at least such a count that all of them together cost no more than ``limit`` bytes."""
    # counts are grouped by powers of 2^(1/8), so that the driver sees a few hundred rows at any size
    band = F.floor(F.log2("n") * 8).cast("int")
    floor, total = None, 0
    for b, c in sorted(words.groupBy(band.alias("b")).agg(F.sum(cost)).collect(), reverse=True):
        total += c
        if total > limit:
            break
        floor = b
    return words.where(F.lit(False) if floor is None else band >= floor)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, h, word, ids): the words with their hashes, and the ranges these are in."""
    for batch in batches:
        h = _hashes(batch.column("word"))
        part = (h >> np.uint64(32)) * np.uint64(RANGES) >> np.uint64(32)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(h.view(np.int64)), batch.column("word"), batch.column("ids")], names=["part", "h", "word", "ids"])


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's words by hash as the bytes of its columns."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    h = rows.column("h").to_numpy().view(np.uint64)
    rows = rows.take(pa.array(np.argsort(h, kind="stable"))).combine_chunks()
    words, ids = rows.column("word").chunk(0), rows.column("ids").chunk(0)
    columns = [
        rows.column("h").to_numpy(),
        _buffers(words)[0],
        pc.binary_length(words).to_numpy().astype(np.int32),
        ids.flatten().to_numpy().astype(np.int32),
        pc.list_value_length(ids).to_numpy().astype(np.int32),
    ]
    yield pa.RecordBatch.from_arrays([rows.column("part").chunk(0).slice(0, 1), *(pa.array([c.tobytes()], pa.binary()) for c in columns)], names=["part", *LAYOUT])


def encoded_words(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", limit: int = DICTIONARY_BYTES) -> tuple[bytes, ...]:
    """The most frequent words, as many as take ``limit`` bytes, by hash: the bytes of the columns of ``LAYOUT``."""
    words = scratch(counted_words(docs, text_col), "words")
    # before folding a word is taken to have an id for each four bytes and one more, afterwards they are counted
    likely = frequent(words.where(F.octet_length("word") <= LONG_WORD), 2 * F.octet_length("word") + 20, limit)
    # merging is work for the CPU, not for the reader of few bytes: it is spread over all tasks
    spread = likely.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    folded = scratch(spread.select("word", "n", vocabulary.fold(F.col("word")).alias("ids")), "folded")
    known = frequent(folded, F.octet_length("word") + 4 * F.size("ids") + 16, limit).select("word", "ids")
    ranges = known.mapInArrow(_placed, "part int, h long, word string, ids array<int>").repartitionById(RANGES, F.col("part"))
    laid = scratch(ranges.mapInArrow(_laid_out, "part int, " + ", ".join(f"{c} binary" for c in LAYOUT)), "laid")
    # one range at a time comes to the driver, a column at a time
    out = []
    for column in LAYOUT:
        pieces = {row["part"]: bytes(row[column]) for row in laid.select("part", column).toLocalIterator()}
        out.append(b"".join(pieces[part] for part in sorted(pieces)))
    release(words, folded, laid)
    return tuple(out)


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, some at a time."""
    data, off = _buffers(words)
    out = np.empty(len(words), np.uint64)
    first = 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(off, off[first] + HASHED_BYTES, side="right")) - 1)
        part = data[off[first] : off[last]]
        p, inverse = _power_tables(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=total[1:])
        a, b = off[first:last] - off[first], off[first + 1 : last + 1] - off[first]
        out[first:last] = mix64((total[b] - total[a]) * inverse[a] ^ (b - a).astype(np.uint64))
        first = last
    return out


class _Dictionary:
    """Ids of the frequent words by hash; one in each Python worker, its arrays lie in the broadcast bytes."""

    def __init__(self, data: tuple[bytes, ...]) -> None:
        self.hash, length, self.ids, count = (np.frombuffer(data[LAYOUT.index(c)], kind) for c, kind in (("hash", np.uint64), ("length", np.int32), ("ids", np.int32), ("count", np.int32)))
        ends, self.ptr = (np.concatenate((np.zeros(1, np.int32), np.cumsum(c, dtype=np.int32))) for c in (length, count))
        self.words = pa.Array.from_buffers(pa.string(), len(self.hash), [None, pa.py_buffer(ends), pa.py_buffer(data[LAYOUT.index("word")])])

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where it is not known."""
        if not len(self.hash):
            return np.full(len(words), -1, np.int64)
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == h)
        same = pc.equal(self.words.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        out = np.full(len(words), -1, np.int64)
        out[hit[same]] = at[hit[same]]
        return out


_dictionaries: dict[str, _Dictionary] = {}


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes of runs, one after the other."""
    ends = np.cumsum(size, dtype=np.int64)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def _coded(texts: pa.Array, kinds: np.ndarray, known: _Dictionary, ranks: Broadcast) -> pa.Array:
    """(parts, rare) of texts: runs of ids of known words, and -1 - i for the i-th of the words that the dictionary lacks."""
    flat, last = cut(texts, kinds)
    row = np.repeat(np.arange(len(texts)), np.diff(last))
    coded = flat.dictionary_encode()
    which, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    at = known.find(words)
    hit = np.flatnonzero(at >= 0)
    long = np.flatnonzero((at < 0) & (pc.binary_length(words).to_numpy(zero_copy_only=False) > LONG_WORD))
    merged = [merge_bytes(w, ranks.value) for w in words.take(pa.array(long)).to_pylist()]
    # only the ids of these texts' words are copied, each word's once
    begins = known.ptr[at[hit]]
    size = known.ptr[at[hit] + 1] - begins
    ids = np.concatenate([known.ids[_runs(begins, size)], *(np.array(x, np.int32) for x in merged)])
    ptr = np.concatenate(([0], np.cumsum(np.concatenate((size, np.array([len(x) for x in merged], np.int64))))))
    at = np.full(len(words), -1, np.int64)
    at[hit], at[long] = np.arange(len(hit)), len(hit) + np.arange(len(long))
    at = at[which]
    # each row's rare words, once
    rare = np.flatnonzero(at < 0)
    pair, back = np.unique(row[rare] * (len(words) + 1) + which[rare], return_inverse=True)
    owner = pair // (len(words) + 1)
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    begins = ptr[np.maximum(at, 0)]
    size = np.where(at < 0, 1, ptr[np.minimum(np.maximum(at, 0) + 1, len(ptr) - 1)] - begins)
    total = np.concatenate(([0], np.cumsum(size)))
    codes = np.empty(total[-1], np.int32)
    mine = at >= 0
    codes[np.repeat(mine, size)] = ids[_runs(begins[mine], size[mine])]
    codes[total[rare]] = -1 - (back - begin[row[rare]])
    # parts end with a text, and before and after each rare word
    alone = total[rare]
    ends = np.unique(np.concatenate((total[last], alone, alone + 1)))
    lists_of = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
    parts = lists_of(lists_of(pa.array(codes), ends), np.searchsorted(ends, total[last]))
    return pa.StructArray.from_arrays([parts, lists_of(words.take(pa.array(pair % (len(words) + 1))), begin)], names=["parts", "rare"], mask=texts.is_null())


def _coder(table: Broadcast, ranks: Broadcast, kinds: Broadcast, key: str):  # noqa: ANN202
    @F.arrow_udf("struct<parts:array<array<int>>,rare:array<string>>")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _dictionaries:
            _dictionaries.clear()
            _dictionaries[key] = _Dictionary(table.value)
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([texts], names=["text"])
            # each slice's ids leave before the next is cut: all of a batch's would be as large as its texts, here and in Spark
            for x in slices(iter([rows]), "text", CUT_BYTES):
                yield _coded(x.column("text"), np.frombuffer(kinds.value, np.uint8), _dictionaries[key], ranks)
        packed.give_back()

    return code


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", out: str = "ids", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """The rows with the ids of their text."""
    table = docs.sparkSession.sparkContext.broadcast(encoded_words(docs, vocabulary, text_col, dictionary_bytes))
    packed.give_back()
    code = _coder(table, vocabulary.shared_ranks, classes(docs.sparkSession), uuid.uuid4().hex)
    either = lambda test, yes, no: F.call_function("if", test, yes, no)
    placed = lambda parts, folded: F.transform(parts, lambda p: either(F.get(p, F.lit(0)) < 0, F.get(folded, -F.get(p, F.lit(0)) - 1), p))
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    coded = F.col("__coded")
    parts = either(F.size(coded["rare"]) == 0, coded["parts"], let(F.transform(coded["rare"], vocabulary.fold), lambda folded: placed(coded["parts"], folded)))
    rows = docs.drop(out).withColumn("__coded", code(F.col(text_col)))
    # flattened outside of any lambda function, where Spark compiles it
    return rows.select(*(c for c in docs.columns if c != out), F.when(F.col(text_col).isNotNull(), F.flatten(parts)).alias(out))


def round_trip(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """The rows with ``ids``, ``n_tokens``, and ``exact``: whether decoding gives back the text."""
    rows = encode(docs, vocabulary, text_col, "ids", dictionary_bytes)
    return rows.withColumns({"n_tokens": F.size("ids").cast("long"), "exact": vocabulary.decode(F.col("ids")).eqNullSafe(F.col(text_col))})
