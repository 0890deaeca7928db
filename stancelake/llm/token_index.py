"""Token ids in shard files with a minimal perfect hash index for keyed access.

A shard is one binary blob:

    magic "SLTI1\\0", width (2 or 4 bytes an id), seed
    counts: keys, rows, ids, buckets
    displacements   int32  per bucket    } minimal perfect hash: key -> slot
    fingerprints    uint32 per slot      } of the slot's key, so that foreign keys are refused
    first row       uint32 per slot, n rows uint32 per slot
    row starts      uint64 per row + 1   (in ids, within the shard)
    keys            int64 per row, null flags uint8 per row (for scans)
    raw ids         width x ids, in the order of the rows

Rows are in ascending order of key (null first). Rows that repeat a key share
its slot. A lookup hashes the key, reads one displacement, one slot and one
row range: constant time whatever the shard holds.

Above the shards stands a directory: keys are dealt by their hash to blocks of
about `DIRECTORY_KEYS`, and each block is a minimal perfect hash of its own
that maps a key to the shards that hold it, again with fingerprints. So a key
is found by one directory row and its shard's row, however many there are.

Shards are written by Spark's own writer, a row each with its blob in one
column, so task retries and lost executors are handled by the job's commit and
any store that Spark knows will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancelake.llm.common import scratch_path, slots
from stancelake.llm.encode import END, crc, encoder

MAGIC = b"SLTI1\0"
HEAD = struct.Struct("<6sHQQQQQ")
#: A shard is closed at so many ids or rows, whichever comes first; one long document may exceed it.
SHARD_IDS = 2_000_000
SHARD_ROWS = 20_000
BROADCAST_SHARDS = 100_000
_NULL = np.uint64(0x9E3779B97F4A7C15)
#: Keys of a directory block, about.
DIRECTORY_KEYS = 50_000
DIRECTORY = struct.Struct("<6sQQQQ")
DIRECTORY_MAGIC = b"SLTD1\0"
SHARD_SCHEMA = "part int, seq int, n_rows long, n_ids long, keys array<long>, blob binary"


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over keys."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hashes(keys: np.ndarray, nulls: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = keys.astype(np.int64).view(np.uint64)
    x = np.where(nulls, _NULL, x)
    salt = np.where(nulls, np.uint64(1), np.uint64(0))
    h = _mix(x ^ (salt << np.uint64(63)), seed) ^ salt
    return h, _mix(h, seed + 1), _mix(h, seed + 2)


def _moved(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The slot of n that displacement d sends a key with hash h to."""
    with np.errstate(over="ignore"):
        return (_mix(h + d.astype(np.uint64) * np.uint64(0xD1342543DE82EF95), 0) % np.uint64(n)).astype(np.int64)


def _displace(h: np.ndarray, n: int, taken: np.ndarray) -> tuple[int, np.ndarray]:
    """The first displacement that sends a bucket's keys to free slots of their own; -1 if none is found."""
    base, tries = 0, 8
    while base < 1 << 18:  # a few at first: most buckets are placed at once
        at = _moved(h[None, :], np.arange(base, base + tries)[:, None], n)
        for i in np.flatnonzero(~taken[at].any(axis=1)).tolist():
            if len(set(at[i].tolist())) == len(h):
                return base + i, at[i]
        base, tries = base + tries, min(4096, tries * 8)
    return -1, at[0]


def build_hash(keys: np.ndarray, nulls: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each key) for distinct keys: hash and displace.

    Buckets are placed from the largest on; a bucket of one key takes any
    free slot, stored as its negative. A seed that can't place a bucket is
    replaced by the next.
    """
    n = len(keys)
    buckets = n // 2 + 1
    for seed in range(1, 1000):
        h, f, _ = _hashes(keys, nulls, seed)
        if len(np.unique(f)) < n:
            continue
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=buckets)
        starts = np.concatenate([[0], np.cumsum(counts)])
        disp, slot, taken = np.zeros(buckets, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        fits = True
        for b in np.argsort(-counts, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) < 2:
                break
            d, at = _displace(f[own], n, taken)
            if d < 0:
                fits = False
                break
            disp[b], slot[own], taken[at] = d, at, True
        if not fits:
            continue
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(counts == 1):
            i = order[starts[b]]
            slot[i] = next(free)
            disp[b] = -slot[i] - 1
        return seed, disp, slot
    raise RuntimeError("no seed places every key")


def find_slots(disp: np.ndarray, prints: np.ndarray, seed: int, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for a key whose stored fingerprint differs."""
    n = len(prints)
    if not n:
        return np.full(len(keys), -1)
    h, f, g = _hashes(keys, nulls, seed)
    d = disp[(h % np.uint64(len(disp))).astype(np.int64)].astype(np.int64)
    slot = np.where(d < 0, -d - 1, _moved(f, np.maximum(d, 0), n))
    return np.where(prints[slot] == (g >> np.uint64(32)).astype("<u4"), slot, -1)


def directory_block(keys: np.ndarray, nulls: np.ndarray, blocks: int) -> np.ndarray:
    """The directory block of each key."""
    return (_hashes(keys, nulls, 77)[0] % np.uint64(blocks)).astype(np.int64)


def build_directory(keys: np.ndarray, nulls: np.ndarray, part: np.ndarray, seq: np.ndarray) -> bytes:
    """A block from the places of its keys, in ascending order of (null last, key, part, seq)."""
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.flatnonzero(new)
    seed, disp, slot = build_hash(keys[first], nulls[first])
    prints, row, count = (np.zeros(len(first), dtype="<u4") for _ in range(3))
    prints[slot] = (_hashes(keys[first], nulls[first], seed)[2] >> np.uint64(32)).astype("<u4")
    row[slot], count[slot] = first, np.diff(np.append(first, len(keys)))
    head = DIRECTORY.pack(DIRECTORY_MAGIC, seed, len(first), len(keys), len(disp))
    return b"".join([head, disp.astype("<i4").tobytes(), prints.tobytes(), row.tobytes(), count.tobytes(), part.astype("<i4").tobytes(), seq.astype("<i4").tobytes()])


def places(blob: bytes, key: int | None) -> list[tuple[int, int]]:
    """(part, seq) of the shards that hold a key, in order, from its directory block."""
    magic, seed, n, rows, buckets = DIRECTORY.unpack_from(blob)
    if magic != DIRECTORY_MAGIC:
        raise ValueError("not a directory block")
    at, out = DIRECTORY.size, []
    for kind, count in (("<i4", buckets), ("<u4", n), ("<u4", n), ("<u4", n), ("<i4", rows), ("<i4", rows)):
        out.append(np.frombuffer(blob, dtype=kind, count=count, offset=at))
        at += out[-1].nbytes
    disp, prints, row, count, part, seq = out
    s = int(find_slots(disp, prints, seed, np.array([key or 0], dtype=np.int64), np.array([key is None]))[0])
    return [] if s < 0 else [(int(part[i]), int(seq[i])) for i in range(int(row[s]), int(row[s]) + int(count[s]))]


def build_shard(keys: list, ids: list[bytes], width: int) -> bytes:
    """A blob from rows in ascending order of key (None first); ids as little-endian unsigned 32-bit integers."""
    nulls = np.array([k is None for k in keys], dtype=bool)
    key = np.array([0 if k is None else k for k in keys], dtype=np.int64)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (nulls[1:] != nulls[:-1])
    first = np.flatnonzero(new)
    each = np.diff(np.append(first, len(keys)))
    seed, disp, slot = build_hash(key[first], nulls[first])
    prints, row, count = (np.zeros(len(first), dtype="<u4") for _ in range(3))
    prints[slot] = (_hashes(key[first], nulls[first], seed)[2] >> np.uint64(32)).astype("<u4")
    row[slot], count[slot] = first, each
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    raw = np.frombuffer(b"".join(ids), dtype="<u4")
    payload = raw.astype("<u2").tobytes() if width == 2 else raw.tobytes()
    head = HEAD.pack(MAGIC, width, seed, len(first), len(keys), len(raw), len(disp))
    return b"".join([head, disp.astype("<i4").tobytes(), prints.tobytes(), row.tobytes(), count.tobytes(), starts.tobytes(), key.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), payload])


class Shard:
    """Keyed access to a blob; arrays are views of it."""

    def __init__(self, blob: bytes):
        magic, self.width, self.seed, n, rows, ids, buckets = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEAD.size

        def view(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.disp, self.prints, self.row, self.count = view("<i4", buckets), view("<u4", n), view("<u4", n), view("<u4", n)
        self.starts, self.keys, self.nulls = view("<u8", rows + 1), view("<i8", rows), view("u1", rows)
        self.payload = view("<u2" if self.width == 2 else "<u4", ids)

    def find(self, keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for a key whose stored fingerprint differs."""
        return find_slots(self.disp, self.prints, self.seed, keys, nulls)

    def rows(self, key) -> list[np.ndarray]:
        """The ids of each row of a key (None for null); none if the key isn't here."""
        s = int(self.find(np.array([key or 0], dtype=np.int64), np.array([key is None]))[0])
        if s < 0:
            return []
        first = int(self.row[s])
        return [self.payload[int(self.starts[r]) : int(self.starts[r + 1])] for r in range(first, first + int(self.count[s]))]


def write_index(docs: DataFrame, path: str, vocabulary: str, kind: str = "word", width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the shards to a path in the shared store.

    Null text counts as empty (the end id alone); a null id sorts first;
    repeated ids share a slot, in the order of their texts' hashes; an empty
    table writes no shards. Other columns aren't read. The text is dealt by
    ranges of (id, hash of text), so that one id with very many rows is split
    too. width 2 asks for a vocabulary below 65,536 ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, kind)
        part, seq, held = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[bytes] = []

        def out() -> pa.RecordBatch:
            row = (part, seq, len(keys), held, list(dict.fromkeys(keys)), build_shard(keys, ids, width))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.record_batch([pa.array([x], type=t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            texts = (x.as_py() or "" for x in batch.column(1))
            for doc, row in zip(batch.column(0).to_pylist(), own.many(texts), strict=True):
                keys.append(doc)
                ids.append(row + END)
                held += len(row) // 4 + 1
                if held >= SHARD_IDS or len(keys) >= SHARD_ROWS:
                    yield out()
                    keys, ids, seq, held = [], [], seq + 1, 0
        if keys:
            yield out()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    spread = rows.repartitionByRange(slots(docs.sparkSession), "doc_id", F.xxhash64("text"))
    spread.sortWithinPartitions("doc_id", F.xxhash64("text")).select("doc_id", "text").mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/shards")
    write_directory(open_index(docs.sparkSession, path).shards, path)


def write_directory(shards: DataFrame, path: str) -> None:
    """Write the directory of written shards: their keys alone are read, and dealt by hash, so no block grows with one key."""
    blocks = max(1, -(-int(shards.agg(F.sum(F.size("keys"))).first()[0] or 0) // DIRECTORY_KEYS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                block = directory_block(batch.column(0).fill_null(0).to_numpy(), nulls, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", "key", "part", "seq"])

    def built(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("part", "ascending"), ("seq", "ascending")]).combine_chunks()
        nulls = t.column("key").is_null().to_numpy()
        blob = build_directory(t.column("key").fill_null(0).to_numpy(), nulls, t.column("part").to_numpy(), t.column("seq").to_numpy())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    own = shards.select(F.explode("keys").alias("key"), "part", "seq").mapInArrow(dealt, "block long, key long, part int, seq int")
    own.groupBy("block").applyInArrow(built, "block long, blob binary").withColumn("blocks", F.lit(blocks)).write.option("compression", "uncompressed").parquet(f"{path}/directory")


def read_index(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, by keyed lookups in every shard.

    start counts the ids of all rows before it: sums by input partition (as
    many rows as partitions) plus sums within one.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sums = shards.select("part", "seq", "n_ids").withColumn("own", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    base = sums.join(totals, "part").select("part", "seq", (F.col("before") + F.col("own")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for base, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(blob.as_py())
                nulls = shard.nulls.astype(bool)
                new = np.ones(len(nulls), dtype=bool)
                new[1:] = (shard.keys[1:] != shard.keys[:-1]) | (nulls[1:] != nulls[:-1])
                first = np.flatnonzero(new)
                at = shard.find(shard.keys[first], nulls[first])
                if (at < 0).any():
                    raise RuntimeError("a key of the shard isn't in its index")
                out: list[list] = [[] for _ in names]
                for k, null, row, count in zip(shard.keys[first].tolist(), nulls[first].tolist(), shard.row[at].tolist(), shard.count[at].tolist(), strict=True):
                    for r in range(row, row + count):
                        a, b = int(shard.starts[r]), int(shard.starts[r + 1])
                        for column, x in zip(out, (None if null else k, base + a, b - a, crc(shard.payload[a:b].astype("<u4").tobytes())), strict=True):
                            column.append(x)
                yield pa.record_batch([pa.array(c, type=pa.int64()) for c in out], names=names)

    if base.count() <= BROADCAST_SHARDS:  # three numbers a shard; else both sides are shuffled
        base = F.broadcast(base)
    return shards.select("part", "seq", "blob").join(base, ["part", "seq"]).select("base", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def index_documents(docs: DataFrame, vocabulary: str, **how) -> DataFrame:
    """Write the index to the shared folder and return what it holds."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-index")
    write_index(docs, path, vocabulary, **how)
    return read_index(open_index(spark, path).shards)


class Index(NamedTuple):
    """The shards and the directory of an index, blobs unread until asked for."""

    shards: DataFrame
    directory: DataFrame | None


def open_index(spark: SparkSession, path: str) -> Index:
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/directory")
    known = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return Index(shards, spark.read.schema("block long, blob binary, blocks int").parquet(f"{path}/directory") if known else None)


def fetch(index: Index, key: int | None) -> list[list[int]]:
    """The ids of each row of one key; none if it isn't there.

    One row of the directory says which shards hold the key, and only their
    rows are read: both are asked for by numbers that the files' statistics
    filter. A key whose rows were split lies in several shards, in order.
    """
    blocks = index.directory.select("blocks").first()
    if blocks is None:
        return []
    block = int(directory_block(np.array([key or 0], dtype=np.int64), np.array([key is None]), blocks[0])[0])
    row = index.directory.where(F.col("block") == block).select("blob").first()
    out = []
    for part, seq in places(bytes(row["blob"]), key) if row else []:
        blob = index.shards.where((F.col("part") == part) & (F.col("seq") == seq)).select("blob").first()["blob"]
        out += [ids.tolist() for ids in Shard(bytes(blob)).rows(key)]
    return out
