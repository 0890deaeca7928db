"""Near copies at a Jaccard similarity, found by the pigeonhole blocks of wide SimHash fingerprints.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of `LEAST` or more. A bit of their fingerprints then agrees with a
chance of at least 0.848 (the angle between two sets of shingles), so with
enough blocks of a fingerprint a pair shares one of them. A block holds as
many bits as it takes to tell the texts of the table apart, and a fingerprint
as many blocks as keep the chance to share none at `MISS` (`shape`): 43 blocks
of 13 bits for 50,000 texts, 84 of 17 for a million. Pairs that share a block
are held against a Hamming distance over `VERIFY` bits, and what passes against
both texts, exactly.

Only distinct texts are compared, and no pairs leave a task: only the edges of
spanning forests. Shared blocks and the Hamming distance give loose components
first; no link joins two of them. The texts of a loose component then come
together once, and all Jaccard similarities among them are counted exactly. A
block or a loose component with very many texts (or very long ones) is dealt
to tasks by pairs of chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import connected_components, deal, settle, whole_runs
from stancelake.llm.embed_dedup import forest
from stancelake.llm.simhash import SEED, shingle_hashes, spread_counts

SHINGLE, LEAST = 5, 0.8
#: Texts to a key, about.
LOAD = 8
#: How many pairs at the limit may share no block.
MISS = 0.005
#: Bits that are compared once a pair shares a block, in words of 64.
VERIFY = 3
#: Texts of a key, and texts and bytes of a loose component, that make one chunk.
BLOCK, CHUNK, CHUNK_BYTES = 4096, 1024, 8 << 20
#: Runs up to this length are compared shift by shift, longer ones star by star.
SHORT_RUN = 16


def agreement(least: float) -> float:
    """The least chance that a bit agrees for sets at this Jaccard similarity: the cosine is smallest for sets of equal size."""
    return 1 - math.acos(2 * least / (1 + least)) / math.pi


def shape(texts: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """(bits of a block, blocks) for so many distinct texts."""
    bits = min(48, max(12, math.ceil(math.log2(max(texts / LOAD, 1)))))
    return bits, math.ceil(math.log(miss) / math.log(1 - agreement(least) ** bits))


def most_bits(least: float = LEAST) -> int:
    """The Hamming distance over the compared bits that pairs at the limit keep, but for one in some 700."""
    n, p = 64 * VERIFY, 1 - agreement(least)
    return math.ceil(n * p + 3 * math.sqrt(n * p * (1 - p)))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a UTF-8 text's word shingles, in order; the whole of a shorter text; none without words."""
    return np.unique(shingle_hashes(text, shingle, SEED))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits, one a byte: the majority over derived hashes of the shingles; h isn't empty."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    counts = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, len(h), 2040):
        x = h[at : at + 2040, None] * odd
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        counts += spread_counts(x)
    return counts * 2 > len(h)


def _classes(docs: DataFrame, bits: int, blocks: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, keys, sketch) of every row: node is the text's hash, zero and no keys for a text without words."""
    words = max(VERIFY, -(-bits * blocks // 64))
    powers = 1 << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, keys, sketch = batch.column(1).to_numpy().copy(), [], []
            for i, x in enumerate(batch.column(2)):
                h = shingles(x.as_py() or b"")
                if not len(h):
                    node[i] = 0
                    keys.append([])
                    sketch.append([])
                    continue
                fp = fingerprint(h, words)
                keys.append(fp[: bits * blocks].reshape(blocks, bits) @ powers)
                sketch.append(np.packbits(fp[: 64 * VERIFY], bitorder="little").view(np.int64))
            lists = [pa.array(c, type=pa.list_(pa.int64())) for c in (keys, sketch)]
            yield pa.record_batch([batch.column(0), pa.array(node), *lists], names=["doc_id", "node", "keys", "sketch"])

    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, keys array<long>, sketch array<long>")


def _far(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64)


def _joined(run: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of the same run that join what pairs within `most` bits join."""
    first = np.flatnonzero(np.diff(run, prepend=-1))
    size = np.diff(np.append(first, len(run)))
    short = size[run] <= SHORT_RUN
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for d in range(1, int(min(SHORT_RUN, size.max(initial=1)))):
        i = np.flatnonzero((run[d:] == run[:-d]) & short[d:])
        i = i[_far(fp, i, i + d) <= most]
        a.append(i)
        b.append(i + d)
    for r in np.flatnonzero(size > SHORT_RUN):
        rest = np.arange(first[r], first[r] + size[r])
        while len(rest) > 1:
            open_, rest = [rest[0]], rest[1:]
            while open_ and len(rest):
                at = open_.pop()
                near = np.bitwise_count(fp[rest] ^ fp[at]).sum(axis=1, dtype=np.int64) <= most
                if near.any():
                    a.append(np.full(near.sum(), at))
                    b.append(rest[near])
                    open_ += rest[near].tolist()
                    rest = rest[~near]
    return np.concatenate(a), np.concatenate(b)


def _edges(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A spanning forest of the pairs of rows, as edges of nodes."""
    low = forest(len(node), a, b)
    moved = np.flatnonzero(low != np.arange(len(node)))
    return pa.record_batch([pa.array(node[moved]), pa.array(node[low[moved]])], names=["a", "b"])


def _loose(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """For partitions sorted by (t, key, one, two): edges among the nodes of a key that are within `most` bits."""
    for t in whole_runs(batches, 4):
        new = np.zeros(t.num_rows, dtype=bool)
        for c in ("t", "key", "one", "two"):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        fp = np.stack([t.column(f"f{i}").to_numpy() for i in range(VERIFY)], axis=1).view(np.uint64)
        yield _edges(t.column("node").to_numpy(), *_joined(np.cumsum(new), fp, most))


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) whose sets have a Jaccard similarity of `least` or more, exactly."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # hashes of one set alone count in no intersection
    keep = count[column] > 1
    owner, column = owner[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    size = np.array([len(x) for x in sets], dtype=np.float64)
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, 4096):
        x, y = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(sets), 4096), dtype=np.float32)
        has[owner[x:y], column[x:y] - at] = 1
        both += has[left] @ has[right].T
    i, j = np.nonzero(both >= least * (size[left][:, None] + size[right][None, :] - both) - 1e-6)
    return left[i], right[j]


def _linked(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """For partitions sorted by (loose, one, two): edges among the nodes of a loose component whose texts are similar enough."""
    for t in whole_runs(batches, 3):
        loose, one, two, chunk, node = (t.column(c).to_numpy() for c in ("loose", "one", "two", "chunk", "node"))
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = (loose[1:] != loose[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        start = np.append(np.flatnonzero(new), t.num_rows)
        for x, y in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
            if y - x < 2:
                continue
            sets = [shingles(v.as_py()) for v in t.column("text").slice(x, y - x)]
            if one[x] == two[x]:
                left = right = np.arange(y - x)
            else:
                left, right = np.flatnonzero(chunk[x:y] == one[x]), np.flatnonzero(chunk[x:y] == two[x])
            yield _edges(node[x:y], *similar(sets, left, right, least))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(node, first_id, component) of every distinct text: its hash, the smallest id that has it, the hash that names its component.

    Texts without words are one class, linked with nothing else.
    """
    bits, blocks = shape(docs.count(), least)
    own = _classes(docs, bits, blocks, id_col, text_col)
    nodes = settle(own.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "copies-classes")
    most, order = most_bits(least), ["t", "key", "one", "two"]
    keyed = nodes.select("node", F.posexplode("keys").alias("t", "key"), *[F.col("sketch")[i].alias(f"f{i}") for i in range(VERIFY)])
    keyed = deal(keyed, ["t", "key"], "node", block, "copies-hot")(keyed).select(*order, "node", *[f"f{i}" for i in range(VERIFY)])
    found = keyed.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(lambda x: _loose(x, most), "a long, b long")
    loose = settle(connected_components(found, "copies-cc").select("node", F.col("component").alias("loose")), "copies-loose")
    text = docs[text_col].cast("string")
    texts = docs.select(F.xxhash64(F.coalesce(text, F.lit(""))).alias("node"), text.cast("binary").alias("text"))
    # exact copies become one text before anything is shuffled; nodes grow with the rows, so they are never broadcast
    texts = settle(texts.groupBy("node").agg(F.first("text").alias("text")).join(loose.hint("merge"), "node").select("node", "loose", "text"), "copies-texts")
    sized = texts.select("loose", "node", "text", F.octet_length("text").alias("bytes"))
    order = ["loose", "one", "two"]
    sized = deal(sized, ["loose"], "node", chunk, "copies-big", F.sum("bytes") / CHUNK_BYTES)(sized).select(*order, "chunk", "node", "text")
    linked = sized.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(lambda x: _linked(x, least), "a long, b long")
    joined = connected_components(linked, "copies-cc")
    return nodes.select("node", "first_id").join(joined, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs without all but one row of every component of near copies, with all its columns.

    The row with the smallest id stays (nulls last, ties by the text's hash);
    of rows that repeat both id and text one stays. So rows that share an id
    but not a component are decided one by one. Null, empty and blank texts
    are copies of one another; an empty table gives no rows; other columns
    aren't read, whatever their names.
    """
    rank = F.struct(F.col("first_id").isNull(), "first_id", "node")
    names = [f"_c{i}" for i in range(len(docs.columns))]  # no name of docs can meet one of ours
    plain = docs.toDF(*names)
    id_at, text_at = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    own = plain.select(id_at.alias("doc_id"), text_at.alias("text"))
    stay = settle(classes(own, least=least).groupBy("component").agg(F.min(rank).alias("k")).select(F.col("k.first_id").alias("_id"), F.col("k.node").alias("_node")), "copies-stay")
    text = F.coalesce(text_at.cast("string"), F.lit(""))
    blank = F.trim(F.translate(text, "\t\n\x0b\x0c\r", " " * 5)) == ""
    keyed = plain.withColumns({"_copies_id": id_at.cast("long"), "_copies_node": F.when(blank, F.lit(0).cast("long")).otherwise(F.xxhash64(text))})
    # ids grow with the rows, so they are merged at every size and never broadcast
    same = F.col("_copies_id").eqNullSafe(F.col("_id")) & (F.col("_copies_node") == F.col("_node"))
    out = settle(keyed.join(stay.hint("merge"), same, "left_semi"), "copies-out")
    again = settle(out.groupBy("_copies_id", "_copies_node").count().where("count > 1").select(F.col("_copies_id").alias("_id"), F.col("_copies_node").alias("_node")), "copies-again")
    if again.isEmpty():
        return out.select(*names).toDF(*docs.columns)
    once = out.join(again.hint("merge"), same, "left_anti")
    return once.unionByName(out.join(again.hint("merge"), same, "left_semi").dropDuplicates(["_copies_id", "_copies_node"])).select(*names).toDF(*docs.columns)
