"""A shuffle of many small rows as few compressed blocks of columns.

Rows of 64-bit keys with integer columns are collected in a map task, sorted by
key, and sent as one block for each receiving task.  Sorted keys are kept as
differences and columns as planes of their bytes, so that a row takes about as
many bytes as it has information, a quarter of a row of Spark's own.  The
receiving task gets all rows whose keys are in its part of the key space.

``salt`` spreads the rows of one key over several tasks: it takes the lowest 16
bits of the key, which is 48 bits long without it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a map task holds before it sends them.
FLUSH_ROWS = 1 << 19
#: Rows beyond which a receiving task makes one of those of equal keys.
FOLD_ROWS = 1 << 20
SALT_BITS = np.uint64(16)

BLOCKS = "part int, block binary"

Columns = list[np.ndarray]
Fold = Callable[[np.ndarray, Columns], tuple[np.ndarray, Columns]]


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and several share a machine."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _planes(values: np.ndarray) -> bytes:
    """Differences from the least value, only the bytes that are used."""
    low = int(values.min())
    rest = (values.astype(np.int64) - low).view(np.uint64) if values.dtype != np.uint64 else values - np.uint64(low)
    width = (int(rest.max()).bit_length() + 7) // 8
    head = np.array([low if low < 1 << 63 else low - (1 << 64)], np.int64).tobytes() + bytes([width])
    return head + np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8).T[:width]).tobytes()


def _unplaned(data: memoryview, n: int) -> tuple[np.ndarray, memoryview]:
    low, width = np.frombuffer(data[:8], np.int64)[0], data[8]
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(data[9 : 9 + width * n], np.uint8).reshape(width, n).T
    return full.view(np.int64).ravel() + low, data[9 + width * n :]


def block(key: np.ndarray, columns: Columns) -> bytes:
    """Rows sorted by key as bytes."""
    raw = np.array([len(key), len(columns)], np.int64).tobytes() + key[:1].astype(np.uint64).tobytes() + _planes(np.diff(key, prepend=key[:1])) + b"".join(_planes(c) for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def rows_of(data: bytes) -> tuple[np.ndarray, Columns]:
    """The key and the columns of a block, as 64-bit integers."""
    raw = memoryview(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    n, count = np.frombuffer(raw[:16], np.int64)
    first, rest = np.frombuffer(raw[16:24], np.uint64)[0], raw[24:]
    steps, rest = _unplaned(rest, n)
    columns = []
    for _ in range(count):
        values, rest = _unplaned(rest, n)
        columns.append(values)
    return first + np.cumsum(steps).view(np.uint64), columns


def parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The receiving task of each key: a range of the upper bits, moved on by the salt."""
    top = (key >> np.uint64(32)) + (key & np.uint64(0xFFFF)) * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)
    return (top * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def salted(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return key >> SALT_BITS << SALT_BITS | salt.astype(np.uint64)


def blocks(key: np.ndarray, columns: Columns, parts: int) -> pa.RecordBatch:
    """One row (part, block) for each task that receives any of the rows, which are sorted by key."""
    part = parts_of(key, parts)
    if (np.diff(part) < 0).any():  # rows are in order but for salted ones
        order = np.argsort(part, kind="stable")
        key, part, columns = key[order], part[order], [c[order] for c in columns]
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
    data = [block(key[a:b], [c[a:b] for c in columns]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]], pa.int32()), pa.array(data, pa.binary())], names=["part", "block"])


def sent(tables: Iterator[tuple[np.ndarray, Columns]], parts: int, reduce: Callable[[np.ndarray, Columns], tuple[np.ndarray, Columns]] | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of (key, columns), once enough rows have come together; ``reduce`` sees them sorted by (key, first column) before they go."""
    held: list[tuple[np.ndarray, Columns]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not size:
            return
        key, columns = np.concatenate([k for k, _ in held]), [np.concatenate(c) for c in zip(*(c for _, c in held))]
        held.clear()
        order = np.lexsort((*columns[:1], key))
        key, columns = key[order], [c[order] for c in columns]
        if reduce:
            key, columns = reduce(key, columns)
        if len(key):
            yield blocks(key, columns, parts)

    for key, columns in tables:
        held.append((key, columns))
        size += len(key)
        if size >= FLUSH_ROWS:
            yield from flush()
            size = 0
    yield from flush()
    give_back()


def part_count(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def received(sent: DataFrame, receive: Callable[[int, np.ndarray, Columns], Iterator[pa.RecordBatch]], schema: str, count: int, fold: Fold | None = None) -> DataFrame:
    """``receive(part, key, columns)`` in each task, with all rows of its part sorted by (key, first column); ``count`` columns.

    ``fold`` makes fewer rows of some as they come in, in any order, so that a task holds about twice what it leaves.
    """
    parts = part_count(sent)

    def joined(held: list[tuple[np.ndarray, Columns]]) -> tuple[np.ndarray, Columns]:
        out = np.concatenate([k for k, _ in held]), [np.concatenate([c[i] for _, c in held]) for i in range(count)]
        held.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, size, limit = [], 0, 0, FOLD_ROWS
        for batch in batches:
            if batch.num_rows:
                part = batch["part"][0].as_py()
            for data in batch["block"]:
                held.append(rows_of(data.as_py()))
                size += len(held[-1][0])
                if fold and size > limit:
                    held = [fold(*joined(held))]
                    size = len(held[0][0])
                    limit = FOLD_ROWS + size
        if not held:
            return
        key, columns = joined(held)
        order = np.lexsort((*columns[:1], key))
        key = key[order]
        for i in range(count):  # one at a time, so that only one is held twice
            columns[i] = columns[i][order]
        del order
        yield from receive(part, key, columns)
        del key, columns
        give_back()

    return sent.repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def exchange(df: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], receive: Callable[[int, np.ndarray, Columns], Iterator[pa.RecordBatch]], schema: str, count: int, fold: Fold | None = None) -> DataFrame:
    """Rows sent in blocks and received by the tasks of their keys."""
    return received(df.mapInArrow(send, BLOCKS), receive, schema, count, fold)
