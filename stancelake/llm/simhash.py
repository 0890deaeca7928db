"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Two fingerprints with at most t differing bits, cut into t + c
blocks, agree in at least c of them; so every choice of c blocks is a table
keyed by the bits of those blocks, and each close pair meets in one of them.
c grows with the number of distinct fingerprints, to keep the keys selective:
every c finds the same pairs.

Only distinct fingerprints are compared; exact copies share one. Rows that
share a key are verified in sorted runs, and a run gives a star for each of
its components rather than its pairs, which is all that components need.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import connected_components, deal, settle, whole_runs

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: (distinct fingerprints up to, blocks of a key): keys stay at a few fingerprints each.
AGREE = ((8_000_000, 2), (1_000_000_000, 3))
#: Runs up to this length are compared shift by shift, longer ones star by star.
SHORT_RUN = 16
#: Fingerprints of a key that one task takes.
BLOCK = 8192

# one byte of a hash, each bit spread to a byte of its own: 255 of them add up without a carry
_SPREAD = np.array([sum((b >> i & 1) << 8 * i for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """The XXH64 hashes of a UTF-8 text's word shingles, repeats included; of the whole sequence if it is shorter; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if n <= shingle:
        return np.array([xxh64_intdigest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n - shingle + 1)


def spread_counts(h: np.ndarray) -> np.ndarray:
    """How often each bit is set in rows of 64-bit words, counted from the first word's lowest bit on."""
    spread = np.add.reduceat(_SPREAD[np.ascontiguousarray(h, dtype="<u8").view(np.uint8).reshape(len(h), -1)], np.arange(0, len(h), 255), axis=0)
    return spread.astype("<u8").view(np.uint8).reshape(len(spread), -1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, unsigned; 0 for a text without words."""
    h = shingle_hashes(text, shingle, seed)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255_000):
        counts += spread_counts(h[at : at + 255_000])
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp), fp the fingerprint's bits as a signed long; null text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, agree: int) -> list[int]:
    """For every choice of `agree` among bits + agree blocks, the bits of the chosen ones, as signed longs."""
    m = bits + agree
    edges = [64 * i // m for i in range(m + 1)]
    block = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(m)]
    out = []
    for chosen in combinations(block, agree):
        x = sum(chosen)
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def stars(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(roots, members) that join each component of fps under links of at most `bits`; no pair twice."""
    out = []
    rest = fps
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        open_ = [root]
        while open_ and len(rest):
            near = np.bitwise_count(rest ^ open_.pop()) <= bits
            if near.any():
                got, rest = rest[near], rest[~near]
                out.append((np.full(len(got), root, dtype=fps.dtype), got))
                open_ += got.tolist()
    return out


def links_in_runs(bits: int):
    """For partitions sorted by (t, key, one, two, fp): edges among the fingerprints of each run."""

    def edges(run: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.diff(run, prepend=-1))
        size = np.diff(np.append(start, len(fp)))
        small = size[run] <= SHORT_RUN
        a, b = [], []
        for d in range(1, int(min(SHORT_RUN, size.max(initial=1)))):
            i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
            a.append(fp[i])
            b.append(fp[i + d])
        for r in np.flatnonzero(size > SHORT_RUN):
            for roots, members in stars(fp[start[r] : start[r] + size[r]], bits):
                a.append(roots)
                b.append(members)
        if a and (k := np.concatenate(a)).size:
            yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, 4):
            new = np.zeros(t.num_rows, dtype=bool)
            for c in ("t", "key", "one", "two"):
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            yield from edges(np.cumsum(new), t.column("fp").to_numpy().view(np.uint64))

    return run


def near_links(fps: DataFrame, bits: int = MAX_BITS, agree: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) that join what links of at most `bits` join.

    fps is a written table. A key with more than `block` fingerprints is dealt
    to several tasks, by pairs of chunks.
    """
    if agree is None:
        n = fps.count()
        agree = next((c for most, c in AGREE if n <= most), 4)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks(bits, agree)])).alias("t", "key"))
    chunks = deal(keyed, ["t", "key"], "fp", block, "simhash-hot")
    order = ["t", "key", "one", "two"]
    rows = chunks(keyed).select(*order, "fp").repartition(*order).sortWithinPartitions(*order, "fp")
    return rows.mapInArrow(links_in_runs(bits), "a long, b long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest doc_id reachable by links, its own included
    (null only if every id of the component is null). Null and empty texts
    have fingerprint zero and are linked like any other; very long texts are
    read whole; a null id is kept; repeated rows give repeated rows, and rows
    that repeat an id with another text stand where their text stands; a bit
    set in just half of the hashes is 0; an empty table gives no rows. Columns
    other than the two are not read, whatever their names.
    """
    own = settle(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    joined = connected_components(near_links(classes.select("fp"), bits), "simhash-cc")
    # written on both sides of the join, so that Spark can split a component with very many members
    places = settle(classes.join(joined, classes.fp == joined.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")), "simhash-places")
    least = settle(places.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-least")
    of_class = places.join(least, "component").select("fp", "component_id")
    return own.join(of_class, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
