"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents of a source are split by a hash of their id into groups of about
``1 / parts`` of a shard, so that a hot source has many groups.  Each group's
vector (bytes, tokens, rows) is divided by a shard's capacity.  Groups are
placed in order of falling size, each where the dot product of its vector with
the shard's residual capacity is highest among the shards that it fits in; if
it fits nowhere, where it overflows least.

Up to ``block`` shards are packed at once.  More are packed as a tree by the same
rule: hashed cells of groups to ``block`` children, then, for all children in
parallel, on to theirs, down to the shards, so that no task grows with the
corpus.  Only group vectors are packed, ``parts`` or so to a shard; documents
get their shard by a join on the group, and texts are read once, for their sizes.
Of equal scores the first shard is taken, of equal groups the first by source
and bucket.

Every row gets a shard: a null id or source counts as a value of its own, a
null text has no bytes and no tokens; rows that repeat an id of one source go
together; ids may be of any type.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.runtime import scratch

SHARD_BYTES = 16 << 20
PARTS = 16
SLACK = 1.02
BLOCK = 256


def _added(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and what rounding took from them."""
    total = a + b
    part = total - a
    return total, (a - (total - part)) + (b - part)


def pack(demand: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Bin of each vector; ``bins`` holds the capacities, one row a bin."""
    residual = bins.astype(float).copy()
    out = np.empty(len(demand), np.int64)
    for i in np.lexsort((np.arange(len(demand)), -demand.max(axis=1, initial=0))):
        need = demand[i]
        # summed with the rounding made good, so that ties stay ties
        score, first = _added(residual[:, 0] * need[0], residual[:, 1] * need[1])
        score, second = _added(score, residual[:, 2] * need[2])
        score += first + second
        fits = (residual >= need - 1e-12).all(axis=1)
        if fits.any():
            score[~fits] = -np.inf
            best = int(np.argmax(score))
        else:
            best = int(np.argmin(np.maximum(need - residual, 0).max(axis=1)))
        out[i] = best
        residual[best] -= need
    return out


def _demand(rows: pd.DataFrame, shards: int) -> np.ndarray:
    """Vectors in units of one shard's share of the whole."""
    values = rows[["bytes", "tokens", "rows"]].to_numpy(float)
    total = rows[["all_bytes", "all_tokens", "all_rows"]].iloc[0].to_numpy(float)
    return values / np.maximum(total / shards, 1e-9)


def _pack_children(block: int, slack: float):
    """Cells of a node to its children, of ``child`` shards each but the last."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell").reset_index(drop=True)
        shards, child, first = int(rows["shards"].iloc[0]), int(rows["child"].iloc[0]), int(rows["first"].iloc[0])
        sizes = np.full(-(-shards // child), child)
        sizes[-1] -= sizes.sum() - shards
        at = pack(_demand(rows, shards), np.repeat(sizes[:, None] * slack, 3, axis=1))
        rows["new_first"], rows["new_shards"] = first + at * child, sizes[at]
        return rows[["first", "cell", "new_first", "new_shards"]]

    return run


def _pack_shards(slack: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "bucket"], na_position="first").reset_index(drop=True)
        shards, first = int(rows["shards"].iloc[0]), int(rows["first"].iloc[0])
        rows["shard"] = first + pack(_demand(rows, shards), np.full((shards, 3), slack))
        return rows[["source", "bucket", "shard"]]

    return run


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows"))


def _with_totals(rows: DataFrame, node: DataFrame) -> DataFrame:
    """Each row with the sums of its node, which its vector is measured by."""
    sums = _summed(node, "first").select("first", *(F.col(c).alias(f"all_{c}") for c in ("bytes", "tokens", "rows")))
    return rows.join(sums, "first")


def _placed(groups: DataFrame, shards: int, block: int, cells: int, slack: float) -> DataFrame:
    """(source, bucket, shard) of the groups.

    A node of more than ``block`` shards is parted to at most ``block`` children:
    its groups fall to ``cells`` cells by their hash, whose sums are packed.  So
    no task packs more than the cells of one node, or the groups of one node of
    at most ``block`` shards, whatever the number of shards.
    """
    nodes = groups.withColumns({"first": F.lit(0).cast("long"), "shards": F.lit(shards).cast("long")})
    width, level = block, 0
    while width < shards:
        width *= block
    while width > block:
        width //= block
        level += 1
        cell = F.pmod(F.xxhash64(F.lit(level), "source", "bucket"), F.lit(cells))
        own = nodes.withColumn("cell", cell)
        vectors = own.groupBy("first", "shards", "cell").agg(*(F.sum(c).alias(c) for c in ("bytes", "tokens", "rows"))).withColumn("child", F.lit(width).cast("long"))
        kept = "first long, cell long, new_first long, new_shards long"
        parted = _with_totals(vectors, vectors).groupBy("first").applyInPandas(_pack_children(block, slack), kept)
        nodes = scratch(own.join(scratch(parted, "parted"), ["first", "cell"]).select("source", "bucket", "bytes", "tokens", "rows", F.col("new_first").alias("first"), F.col("new_shards").alias("shards")), "nodes")
    return _with_totals(nodes, nodes).groupBy("first").applyInPandas(_pack_shards(slack), "source string, bucket long, shard long")


def assign(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shard_bytes: int = SHARD_BYTES, parts: int = PARTS, slack: float = SLACK, block: int = BLOCK, cells: int | None = None) -> DataFrame:
    """(doc_id, source, bytes, tokens, shard) for every row; tokens are the words between blanks and line ends."""
    text = F.col(text_col)
    tokens = F.coalesce(F.size(F.filter(F.split(text, "[ \n]"), lambda w: w != "")), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.when(text.isNull(), F.lit(0)).otherwise(tokens).cast("long").alias("tokens"))
    rows = scratch(sized, "sizes")
    counted = rows.groupBy("source").agg(F.sum("bytes").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    all_bytes, all_tokens, all_rows = (x or 0 for x in counted.agg(F.sum("b"), F.sum("t"), F.sum("n")).first())
    shards = max(1, -(-all_bytes // shard_bytes))
    # a source is split by the largest of its three shares of the whole
    share = F.greatest(F.col("b") / max(all_bytes, 1), F.col("t") / max(all_tokens, 1), F.col("n") / max(all_rows, 1))
    buckets = counted.select(F.col("source").alias("s"), F.ceil(share * shards * parts).alias("buckets"))
    bucketed = rows.join(buckets, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.greatest("buckets", F.lit(1))).cast("long"))
    groups = scratch(bucketed.groupBy("source", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "groups")
    placed = scratch(_placed(groups, shards, block, cells or 64 * block, slack), "placed")
    right = placed.select(F.col("source").alias("s"), F.col("bucket").alias("g"), "shard")
    return bucketed.join(right, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("g"))).select("doc_id", "source", "bytes", "tokens", "shard")
