"""Packing: Karmarkar-Karp multiway differencing of document lengths into windows.

Documents are dealt into blocks by hash, so blocks have like length distributions;
each block is partitioned on its own. Every item begins as a partial partition with
one filled window; the two partial partitions of largest imbalance are merged with
opposing order (fullest onto emptiest) until one is left. A block begins with the
least number of windows its total needs, and the number rises by one for as long
as some window exceeds the capacity.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a window.
CAPACITY = 32_768
#: Mean items in a block, which bounds the work and memory of one partition; every item is in some block.
BLOCK_ITEMS = 2_048


def differencing(lengths: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item, by Karmarkar-Karp differencing into ``k`` windows."""
    n = len(lengths)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64)
    # A partial partition holds its sums in descending order, without the windows
    # that are still empty; its slots count from the fullest, 0.
    sums: list[np.ndarray | None] = [np.array([x], np.int64) for x in lengths]
    nodes: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = [(-int(x), i) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        sums[a] = sums[b] = None
        width = min(k, len(x) + len(y))
        # Slot i of a keeps its place from the left, slot i of b from the right: fullest meets emptiest.
        total = np.zeros(width, np.int64)
        total[: len(x)] += x
        total[width - len(y) :] += y[::-1]
        order = np.argsort(-total, kind="stable")
        rank = np.empty(width, np.int64)
        rank[order] = np.arange(width)
        nodes.append((a, b, rank[: len(x)], rank[width - len(y) :][::-1]))
        total = total[order]
        sums.append(total)
        low = int(total[-1]) if width == k else 0
        heapq.heappush(heap, (low - int(total[0]), len(sums) - 1))
    slots: dict[int, np.ndarray] = {len(sums) - 1: np.arange(len(sums[heap[0][1]]))}
    out = np.zeros(n, np.int64)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, ra, rb = nodes[i]
        at = slots.pop(n + i)
        for child, r in ((a, ra), (b, rb)):
            if child < n:
                out[child] = at[r[0]]
            else:
                slots[child] = at[r]
    return out


def windows(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none above ``capacity``; every length is at most that."""
    if len(lengths) == 0:
        return np.zeros(0, np.int64)
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        at = differencing(lengths, k)
        if np.bincount(at, weights=lengths, minlength=k).max() <= capacity:
            return at
        k += 1


def pack(docs: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, length: Column | None = None) -> DataFrame:
    """Windows of at most ``capacity`` units that hold every document whole or in consecutive pieces.

    One row for each piece: window_id, doc_id, start (first unit), length, position
    in its window and window_length. The unit is the character unless ``length``
    gives another measure. A text longer than the capacity is cut into pieces of the
    capacity, each a window of its own, and a rest that is packed with the others.
    A null or empty text has no piece. Repeated rows are packed as often as they
    occur; equal lengths are taken in order of doc_id. Extra columns are ignored; an
    empty table gives no rows. Only ids and lengths are shuffled, rows that are alike in
    both as one row with their number; no block gets more than ``block_items`` of these
    for each time it is drawn.
    """
    size = (F.length("text") if length is None else length).cast("long")
    items = docs.select(F.col("doc_id"), size.alias("size")).where("size > 0")
    sized = items.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    # Numbers of copies in two steps, so that no row holds more than ``block_items`` of them.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_items)))
    dealt = sized.select("doc_id", "size", "n", part.alias("part")).withColumn("copies", F.least(F.lit(block_items).cast("long"), F.col("n") - F.col("part") * block_items))
    whole = dealt.where(F.col("size") >= capacity).select("doc_id", "size", "part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    whole = whole.select("doc_id", "size", (F.col("part") * block_items + F.col("copy")).alias("copy"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / capacity) - 1)).alias("piece"))
    whole = whole.select(
        F.format_string("w%s.%d.%d.%d", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "copy", "piece").alias("window_id"),
        "doc_id",
        (F.col("piece") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("length"),
        F.lit(0).cast("long").alias("position"),
        F.lit(capacity).cast("long").alias("window_length"),
    )
    n_blocks = max(1, -(-docs.count() // block_items))
    rest = dealt.select("doc_id", (F.col("size") - F.col("size") % capacity).alias("start"), (F.col("size") % capacity).alias("length"), "copies", "part").where("length > 0")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "length", "part"), F.lit(n_blocks))).drop("part")
    schema = T.StructType(
        [
            T.StructField("window_id", T.StringType()),
            rest.schema["doc_id"],
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("position", T.LongType()),
            T.StructField("window_length", T.LongType()),
        ]
    )

    def block(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("copies").to_numpy())))
        table = table.take(pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")]))
        lengths = table.column("length").to_numpy()
        at = windows(lengths, capacity)
        order = np.argsort(at, kind="stable")
        table, at, lengths = table.take(pa.array(order)), at[order], lengths[order]
        sums = np.bincount(at, weights=lengths).astype(np.int64)
        number = table.column("block")[0].as_py()
        return pa.table(
            {
                "window_id": pa.array([f"b{number}.{w}" for w in at.tolist()], pa.string()),
                "doc_id": table.column("doc_id"),
                "start": table.column("start"),
                "length": pa.array(lengths, pa.int64()),
                "position": pa.array(np.arange(len(at)) - np.searchsorted(at, at), pa.int64()),
                "window_length": pa.array(sums[at], pa.int64()),
            }
        )

    return whole.unionByName(rest.groupBy("block").applyInArrow(block, schema))
