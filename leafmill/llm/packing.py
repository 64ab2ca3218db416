"""Packing into windows of equal length by Karmarkar-Karp multiway differencing.

A document is cut into full windows, which stand alone, and a rest of pieces of
at most ``piece`` ids.  The pieces of a group of documents are divided over its
windows: every piece begins as a partial partition of its own; the two with the
largest difference between their fullest and emptiest window are merged, the
fullest of one onto the emptiest of the other, until one partition is left.  If
a window then exceeds the capacity, the group gets one more window and starts
again.  Groups are made by a hash and hold about ``GROUP`` documents at any
size of the table, so they are packed side by side.

Cases: null and empty texts are their end id; repeated rows are packed each on
its own; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.tokens import encode, id_kind, wide

GROUP = 240
# Numbers left for the windows of one group.
NUMBERS = 1 << 24


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Which window each size goes to, and how full the windows get."""
    nodes: list[tuple] = []
    heap = []
    for at in np.argsort(-sizes, kind="stable"):
        sums = np.zeros(windows, np.int64)
        sums[0] = sizes[at]
        heap.append((-int(sizes[at]), len(nodes), sums))
        nodes.append((int(at),))
    if windows == 1:
        return np.zeros(len(sizes), np.int64), np.array([sizes.sum()])
    heapq.heapify(heap)
    while len(heap) > 1:
        _, one, a = heapq.heappop(heap)
        _, two, b = heapq.heappop(heap)
        joined = a + b[::-1]
        order = np.argsort(-joined, kind="stable")
        sums = joined[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(nodes), sums))
        nodes.append((one, two, order))
    if not heap:
        return np.empty(0, np.int64), np.zeros(windows, np.int64)
    _, top, sums = heap[0]
    out = np.empty(len(sizes), np.int64)
    stack = [(top, np.arange(windows))]
    while stack:
        at, window = stack.pop()
        node = nodes[at]
        if len(node) == 1:
            out[node[0]] = window[0]
            continue
        one, two, order = node
        own = np.empty(windows, np.int64)
        own[order] = window
        stack += [(one, own), (two, own[::-1])]
    return out, sums


def pack_pieces(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; the number of windows rises until none overflows."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        chosen, sums = difference(sizes, windows)
        if sums.max() <= capacity:
            return chosen
        windows += 1


def cut(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """Pieces (start, length) of a document: full windows, then near-equal rests."""
    full = n // capacity
    out = [(i * capacity, capacity) for i in range(full)]
    rest, at = n - full * capacity, full * capacity
    parts = -(-rest // piece)
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        out.append((at, length))
        at += length
    return out


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, piece: int = 512,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece: key, start, length, ids (32-bit numbers), doc_tokens, sequence_id, offset."""
    kind = id_kind(tokenizer)
    groups = max(1, -(-docs.select(key).count() // GROUP))
    encoded = encode(docs, tokenizer, key, text, end_id)
    encoded = encoded.withColumn("group", F.pmod(F.xxhash64("key", "n", F.crc32("ids")), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = sorted(range(table.num_rows), key=lambda i: (str(table["key"][i]), table["ids"][i].as_py()))
        rows = []
        for at in order:
            n = table["n"][at].as_py()
            rows += [(at, start, length, n) for start, length in cut(n, capacity, piece)]
        size = np.array([r[2] for r in rows], np.int64)
        loose = np.flatnonzero(size < capacity)
        window = np.empty(len(rows), np.int64)
        window[loose] = pack_pieces(size[loose], capacity) if len(loose) else 0
        full = np.flatnonzero(size == capacity)
        window[full] = window[loose].max(initial=-1) + 1 + np.arange(len(full))
        first = table["group"][0].as_py() * NUMBERS
        filled = np.zeros(int(window.max()) + 1, np.int64)
        offset = np.empty(len(rows), np.int64)
        for at in np.lexsort((np.arange(len(rows)), window)):
            offset[at] = filled[window[at]]
            filled[window[at]] += size[at]
        ids = [np.frombuffer(table["ids"][r[0]].as_py(), kind)[r[1] : r[1] + r[2]] for r in rows]
        return pa.table({
            "key": table["key"].take(pa.array([r[0] for r in rows])),
            "start": pa.array([r[1] for r in rows], pa.int64()),
            "length": pa.array(size),
            "ids": pa.array([wide(i) for i in ids], pa.binary()),
            "doc_tokens": pa.array([r[3] for r in rows], pa.int64()),
            "sequence_id": pa.array(first + window),
            "offset": pa.array(offset),
        })

    kind_of_key = docs.schema[key].dataType.simpleString()
    packed = encoded.groupBy("group").applyInArrow(
        run,
        f"key {kind_of_key}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
    return packed.withColumnRenamed("key", key)
