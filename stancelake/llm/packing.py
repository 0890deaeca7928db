"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document longer than a sequence first gives whole sequences; what is left
of it, and every shorter document, is a part. The parts of a batch are dealt
to k windows by largest differencing: every part starts as a partial
partition of its own, and the two partial partitions with the largest spread
are merged, the fullest window of one with the emptiest of the other. k is
the least count that the total allows and rises while a window exceeds the
capacity. When more than `PADDING` of the room would stay empty that way
(parts too coarse to level), the largest parts are halved again and again
into ever smaller ones and the batch is dealt anew; documents may be cut
freely, and small parts level what large ones leave.

A batch is a bounded run of parts of one input partition, so nothing is
shuffled, and neither one document, a hot source nor a group of copies can
make a task larger than its share of the files.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from stancelake.llm.encode import END, crc, encoder

LENGTH = 2048
#: Parts dealt together; ids held by one batch: at most this many sequences' worth.
BATCH = 1024
PADDING = 0.005
#: A batch's last window may be cut into sequences of these lengths, which need no padding.
LEAST_TAIL = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal parts to k windows by largest differencing; each window's part numbers.

    No parts: k empty windows. Ties go to the part that came first.
    """
    if not sizes:
        return [[] for _ in range(k)]
    # a partial partition: its non-empty windows in ascending order, as sums and as nodes;
    # a node is a part (below n) or a pair of nodes, kept in left and right
    n = len(sizes)
    heap = [(-s, i, np.array([s], dtype=np.int64), np.array([i], dtype=np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    left, right, made = [], [], 0
    for merge in range(n - 1):
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heap[0]
        if len(a) < len(b):
            a, at, b, bt = b, bt, a, at
        m = max(0, len(a) + len(b) - k)  # windows of b that find none of a's empty: its emptiest ones
        sums, nodes = np.concatenate([a, b[m:]]), np.concatenate([at, bt[m:]])
        if m:  # b's m-th smallest to its smallest meet a's m smallest
            sums[:m] += b[m - 1 :: -1]
            left.append(at[:m])
            right.append(bt[m - 1 :: -1])
            nodes[:m] = np.arange(n + made, n + made + m)
            made += m
        order = sums.argsort(kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heapreplace(heap, (-int(sums[-1] - (sums[0] if len(sums) == k else 0)), n + merge, sums, nodes))
    pairs = list(zip(np.concatenate(left).tolist(), np.concatenate(right).tolist(), strict=True)) if left else []
    out = []
    for node in heap[0][3].tolist():
        own, stack = [], [node]
        while stack:
            x = stack.pop()
            if x < n:
                own.append(x)
            else:
                stack += pairs[x - n]
        out.append(sorted(own))
    return out + [[] for _ in range(k - len(out))]


def halved(start: int, length: int) -> list[tuple[int, int]]:
    """Cut a part into halves, quarters and so on, down to 8 ids."""
    out = []
    while length > 15:
        half = length - length // 2
        out.append((start, half))
        start, length = start + half, length - half
    return [*out, (start, length)]


def deal(parts: list[tuple[int, int, int]], capacity: int = LENGTH, padding: float = PADDING) -> list[list[tuple[int, int, int]]]:
    """Windows of (document, start, length), none over capacity.

    parts: (document, start, length), each at most `capacity`. Parts with no
    ids are dropped; an empty list gives no windows.
    """
    parts = [p for p in parts if p[2]]
    if not parts:
        return []
    total = sum(p[2] for p in parts)
    least = -(-total // capacity)
    by_size = sorted(range(len(parts)), key=lambda i: (-parts[i][2], i))
    cut = len(parts) // 32
    while True:
        fine = set(by_size[:cut])
        own = [(d, s, n) for i, (d, start, length) in enumerate(parts) for s, n in (halved(start, length) if i in fine else [(start, length)])]
        sizes = [p[2] for p in own]
        k, most = least, least + int(least * padding)
        while k <= most or cut >= len(parts):
            windows = difference(sizes, k)
            over = max(sum(sizes[i] for i in w) for w in windows)
            if over <= capacity:
                return [[own[i] for i in w] for w in windows if w]
            k += 1
        cut = min(len(parts), max(8, cut * 4))


def tails(parts: list[tuple[int, int, int]], capacity: int = LENGTH) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences of 1024, 512 and 256 ids, cut from the longest parts, that bring the rest near whole windows."""
    left = sum(p[2] for p in parts) % capacity
    out: list[list[tuple[int, int, int]]] = []
    rest = sorted(parts, key=lambda p: -p[2])
    size = capacity // 2
    while size >= LEAST_TAIL and left:
        if left >= size:
            i = next((i for i, p in enumerate(rest) if p[2] >= size), None)
            if i is not None:
                d, s, n = rest[i]
                out.append([(d, s, size)])
                left -= size
                rest[i] = (d, s + size, n - size)
        size //= 2
    return out, [p for p in rest if p[2]]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Rows of `SCHEMA`: every piece of every document and its place.

    Null text counts as empty (one piece: the end id alone). A null id is
    kept as null. Repeated rows are packed once for each row. Other columns,
    whatever their names, are not read. An empty table gives no rows. A
    text longer than a sequence is cut at multiples of the length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, "byte")
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[list] = [[] for _ in names]
        held: list[tuple] = []  # (doc id, ids, start of its rest, tokens)
        width = 4

        def put(doc, start: int, ids: bytes, tokens: int, seq: int, offset: int) -> None:
            for column, x in zip(rows, (doc, start, len(ids) // width, crc(ids), tokens, seq, offset), strict=True):
                column.append(x)

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, type=pa.int64()) for c in rows], names=names)
            for c in rows:
                c.clear()
            return made

        def flush(last: bool) -> None:
            nonlocal sequence
            parts = [(i, start, len(ids) // width) for i, (_, ids, start, _) in enumerate(held)]
            whole, parts = tails(parts, length) if last else ([], parts)
            for window in whole + deal(parts, length):
                at = 0
                for i, start, n in window:
                    doc, ids, base, tokens = held[i]
                    put(doc, start, ids[(start - base) * width : (start - base + n) * width], tokens, sequence, at)
                    at += n
                sequence += 1
            held.clear()

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), own.many(texts), strict=True):
                ids += END
                tokens = len(ids) // width
                full = tokens - tokens % length
                for start in range(0, full, length):
                    put(doc, start, ids[start * width : (start + length) * width], tokens, sequence, 0)
                    sequence += 1
                if full < tokens:
                    held.append((doc, ids[full * width :], full, tokens))
                if len(held) >= BATCH:
                    flush(False)
                if len(rows[0]) >= 20_000:
                    yield out()
        if held:
            flush(True)
        if rows[0]:
            yield out()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)
