"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Each map task streams its documents: whole windows are cut off as they come, and what is left of a document is cut into
pieces of at most PIECE ids that wait for the next batch. A batch is partitioned over k windows: the two partial
partitions with the largest imbalance are merged so that one's fullest window meets the other's emptiest, until one
partition is left. Its windows are nearly equal; where one exceeds the capacity, k rises and the batch is done anew.
Nothing is shuffled, and a task holds one batch at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import text_of
from .tokens import CachedByteBpe

#: Ids of a window, most ids of a piece that is packed with others, windows of a batch, the id after each document.
CAPACITY = 1024
PIECE = 256
WINDOWS = 128
END_ID = 0

SCHEMA = "doc_id long, sequence_id long, offset long, start long, length long, doc_tokens long, ids binary"


def difference(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each item, and the windows' sums, by k-way differencing. Ties go to the partition made first."""
    if k == 1:
        return np.zeros(len(sizes), int), np.array([sum(sizes)])
    heap = []
    for i, x in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = x
        heap.append((-x, i, sums, i))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, left = heapq.heappop(heap)
        _, _, b, right = heapq.heappop(heap)
        both = a + b[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        heapq.heappush(heap, (-int(both[0]), made, both, (left, right, order)))
        made += 1
    windows = np.empty(len(sizes), int)
    stack = [(heap[0][3], np.arange(k))]
    while stack:
        node, where = stack.pop()
        if isinstance(node, int):
            windows[node] = where[0]
            continue
        left, right, order = node
        place = np.empty(k, int)
        place[order] = where
        stack += [(left, place), (right, place[::-1])]
    return windows, np.bincount(windows, weights=sizes, minlength=k).astype(np.int64)


def balanced(sizes: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Window of each item, none above capacity; the number of windows rises from its least until that holds."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows, sums = difference(sizes, k)
        if sums.max() <= capacity:
            return windows
        k += max(1, k // 128)


def pieces_of(n: int, capacity: int, piece: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(start, length) of the whole windows of n ids, and of the pieces of the rest, which are as equal as can be."""
    full = n // capacity * capacity
    rest = n - full
    parts = -(-rest // piece)
    cuts = [full + rest * i // parts for i in range(parts + 1)] if parts else []
    return [(s, capacity) for s in range(0, full, capacity)], [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS) -> DataFrame:
    """One row per piece: doc_id, sequence_id, offset in the sequence, start in the document, length, doc_tokens, ids.

    docs has doc_id and text; other columns are ignored. A document is its ids and END_ID, so null and empty texts are
    one id long. Each id lies in one piece, a sequence has at most capacity ids without gaps, and a repeated row is a
    document of its own. ids are little-endian unsigned 32-bit. An empty table gives no rows.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = CachedByteBpe(tokenizer_path)
        made = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = out_ids = 0

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def settle() -> None:
            nonlocal made, held, waiting
            place = balanced([w[2] for w in waiting], capacity)
            offsets: dict[int, int] = {}
            for (doc, start, length, total, ids), w in zip(waiting, place.tolist(), strict=True):
                at = offsets.get(w, 0)
                rows.append((doc, made + w, at, start, length, total, ids))
                offsets[w] = at + length
            made += int(place.max()) + 1
            waiting, held = [], 0

        def tokenized(batch) -> Iterator[tuple[int | None, bytes]]:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield from zip(part.column(0).to_pylist(), [x + end for x in bpe.ids(part.column(1).to_pylist())], strict=True)

        for batch in batches:
            for doc, ids in tokenized(batch):
                total = len(ids) // 4
                whole, rest = pieces_of(total, capacity, piece)
                for start, length in whole:
                    rows.append((doc, made, 0, start, length, total, ids[4 * start : 4 * (start + length)]))
                    made += 1
                for start, length in rest:
                    waiting.append((doc, start, length, total, ids[4 * start : 4 * (start + length)]))
                    held += length
                out_ids += total
                if held >= windows * capacity:
                    settle()
                if out_ids > 2_000_000 and rows:
                    yield table()
                    rows, out_ids = [], 0
        if waiting:
            settle()
        if rows:
            yield table()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(task, SCHEMA)


def packing_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """pack() with a digest instead of the ids themselves."""
    from pyspark.sql import functions as F

    return pack(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
