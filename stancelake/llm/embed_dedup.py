"""Near-duplicate embeddings by cross-polytope hashing with multiprobe.

A hash rotates a unit vector by three rounds of random signs and a fast
Hadamard transform and takes the coordinate of largest size with its sign. A
key joins hashes, the last of them over fewer coordinates, so that there are
about as many keys as vectors of a label at every size of the table (`widths`)
and a bucket holds a few vectors. In each table a vector has the `PROBES` keys
that lie nearest to it; vectors that share one are compared exactly, in double
precision.

The number of tables is what keeps the recall: random pairs at the limit are
hashed on the driver, and tables are added until a pair misses them all less
than once in 1 / `MISS` (`tables_for`). Nearer pairs miss less often.

Only distinct vectors of a label are hashed; copies count through their
multiplicity. A bucket with more than `BLOCK` vectors, which only many near
copies fill, is split into chunks, and each pair of chunks is a run of its
own. A pair that shares several buckets counts in the smallest of their keys
alone, so no pairs leave a task: only the links that each vector has there,
and the edges of a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import connected_components, deal, settle, whole_runs

LEAST = 0.98
PROBES = 4
#: Vectors of a label to a key, about.
LOAD = 4
#: How many pairs at the limit may miss every table.
MISS = 1e-4
BLOCK = 4096
#: Runs up to this length are compared shift by shift, longer ones by matrix products.
SHORT_RUN = 32
SEED = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row, scaled to keep lengths; the width is a power of two."""
    n, d = x.shape
    y = x.copy()
    h = 1
    while h < d:
        z = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and Hadamard transforms, padded to a power of two."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], size=d))
    return y


def widths(rows: int, dim: int, load: float = LOAD) -> list[int]:
    """The coordinates that each hash of a key looks at, for a label of `rows` vectors: 2 * w values each."""
    full = 1 << max(0, (dim - 1).bit_length())
    bits = max(1, int(np.ceil(np.log2(max(rows / load, 2.0)))))
    each = full.bit_length()  # log2 of 2 * full
    out = [full] * (bits // each)
    return out + [1 << (bits % each - 1)] if bits % each else out


def codes(unit: np.ndarray, wide: list[int], tables: int, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """The bucket keys of every row, all distinct: in each table those of the `probes` nearest corners."""
    n, out = len(unit), []
    for t in range(tables):
        key, cost = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
        for k, w in enumerate(wide):
            y = rotate(unit, seed * 1_000_003 + t * 101 + k)[:, :w]
            size = np.abs(y)
            top = np.argsort(-size, axis=1, kind="stable")[:, : min(probes, w)]
            own = top * 2 + (np.take_along_axis(y, top, 1) > 0)
            size = np.take_along_axis(size, top, 1)
            key = (key[:, :, None] * (2 * w) + own[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + (size[:, :1] - size)[:, None, :]).reshape(n, -1)
            first = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            key, cost = np.take_along_axis(key, first, 1), np.take_along_axis(cost, first, 1)
        out.append(key * tables + t)
    return np.concatenate(out, axis=1)


def tables_for(dim: int, wide: list[int], least: float, miss: float = MISS, pairs: int = 4000) -> int:
    """Tables after which a pair at cosine `least` has missed them all with a chance of at most `miss`, by simulation."""
    if dim < 2:
        return 1
    rng = np.random.default_rng(SEED)
    x = units(rng.standard_normal((pairs, dim)))
    g = rng.standard_normal((pairs, dim))
    g = units(g - (g * x).sum(axis=1, keepdims=True) * x)
    y = least * x + np.sqrt(max(0.0, 1 - least * least)) * g
    met = (codes(x, wide, 1)[:, :, None] == codes(y, wide, 1)[:, None, :]).any(axis=(1, 2)).mean()
    met -= 2 * np.sqrt(max(met * (1 - met), 1 / pairs) / pairs)  # the simulation's own error
    return max(1, int(np.ceil(np.log(miss) / np.log(1 - min(max(met, 1e-3), 1 - 1e-9)))))


def units(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small numbers stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _near(unit: np.ndarray, run: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: np.ndarray, crossed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of the same run that are near enough; in a crossed run only those of two chunks."""
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    short = size[run] <= SHORT_RUN
    for d in range(1, int(min(SHORT_RUN, size.max(initial=1)))):
        i = np.flatnonzero((run[d:] == run[:-d]) & short[d:] & ~(crossed[run[d:]] & (chunk[d:] == chunk[:-d])))
        for at in range(0, len(i), 65_536):
            p = i[at : at + 65_536]
            p = p[np.einsum("ij,ij->i", unit[p], unit[p + d]) >= least]
            a.append(p)
            b.append(p + d)
    for r in np.flatnonzero(size > SHORT_RUN):
        rows = np.arange(first[r], first[r] + size[r])
        left = rows[chunk[rows] == chunk[rows[0]]] if crossed[r] else rows
        right = rows[chunk[rows] != chunk[rows[0]]] if crossed[r] else rows
        for at in range(0, len(left), 512):
            x, y = np.nonzero(unit[left[at : at + 512]] @ unit[right].T >= least)
            x, y = left[at + x], right[y]
            a.append(x if crossed[r] else x[x < y])
            b.append(y if crossed[r] else y[x < y])
    return np.concatenate(a), np.concatenate(b)


def run_links(key: np.ndarray, run: np.ndarray, vectors: np.ndarray, keys: np.ndarray, chunk: np.ndarray, crossed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of whole runs (numbered from 0 in order), each pair in the run of its smallest common key alone."""
    first = np.flatnonzero(np.diff(run, prepend=-1))
    a, b = _near(units(vectors), run, first, np.diff(np.append(first, len(run))), chunk, crossed[first], least)
    keep = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 100_000):
        x, y = keys[a[at : at + 100_000]], keys[b[at : at + 100_000]]
        keep[at : at + 100_000] = ~((x[:, :, None] == y[:, None, :]) & (x < key[a[at : at + 100_000], None])[:, :, None]).any(axis=(1, 2))
    return a[keep], b[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes reaches by the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _valid(v) -> "F.Column":
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def links(vectors: DataFrame, least: float = LEAST, block: int = BLOCK, load: float = LOAD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors.

    Vectors are compared if their labels are equal and not null and their
    dimensions agree. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing: component_id is their own id. Rows
    are vectors of their own, be their ids null or repeated: each has its own
    links, and component_id is the smallest id that any row of the component
    has (null only if none has one). Rows that tie in that id are all kept. An
    empty table gives no rows; other columns aren't read, whatever their names.
    """
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "array<float>" if single else "array<double>"  # compared in double precision either way
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast(kind).alias("v"), vectors[label_col].cast("long").alias("label"))
    rows = rows.withColumn("ok", _valid(F.col("v")) & F.col("label").isNotNull())
    good = rows.where("ok").select("vec_id", "label", "v")
    # a row for each dimension that occurs
    sizes = good.groupBy("label", F.size("v").alias("dim")).count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    shape = {r.dim: (w := widths(r.n, r.dim, load), tables_for(r.dim, w, least)) for r in sizes}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys: list = [None] * batch.num_rows
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                own = codes(units(flat[(starts[at][:, None] + np.arange(d)[None, :])]), *shape[d])
                for i, k in zip(at.tolist(), own, strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, type=pa.list_(pa.int64()))], names=["label", "v", "first_id", "copies", "keys"])

    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    coded = classes.mapInArrow(hashed, f"label long, v {kind}, first_id long, copies long, keys array<long>")
    coded = settle(coded.withColumn("node", F.monotonically_increasing_id()), "embed-codes")
    dealt = coded.withColumn("dim", F.size("v")).select("*", F.explode("keys").alias("key"))
    chunks = deal(dealt.select("label", "dim", "key", "node"), ["label", "dim", "key"], "node", block, "embed-hot")
    at = ["label", "dim", "key", "one", "two"]
    dealt = chunks(dealt).select(*at, "chunk", "node", "copies", "v", "keys")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches, 5):
            dims = whole.column("dim").to_numpy()
            for d in np.unique(dims):
                t = whole.filter(pa.array(dims == d)) if (dims != d).any() else whole
                n = t.num_rows
                flat = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("v", "keys")]
                label, key, one, two, chunk, node, copies = (t.column(c).to_numpy() for c in ("label", "key", "one", "two", "chunk", "node", "copies"))
                same = (label[1:] == label[:-1]) & (key[1:] == key[:-1]) & (one[1:] == one[:-1]) & (two[1:] == two[:-1])
                run = np.concatenate([[0], np.cumsum(~same)])
                a, b = run_links(key, run, flat[0].reshape(n, -1), flat[1].reshape(n, -1), chunk, one != two, least)
                if not len(a):
                    continue
                n_links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
                has = np.flatnonzero(n_links)
                low = forest(n, a, b)
                moved = np.flatnonzero(low != np.arange(n))
                none = lambda k: pa.nulls(k, pa.int64())
                columns = ([pa.array(node[has]), pa.array(node[moved])], [none(len(has)), pa.array(node[low[moved]])], [pa.array(n_links[has].astype(np.int64)), none(len(moved))])
                yield pa.record_batch([pa.concat_arrays(c) for c in columns], names=["a", "b", "n"])

    found = settle(dealt.repartition(*at).sortWithinPartitions(*at).mapInArrow(linked, "a long, b long, n long"), "embed-links")
    counts = settle(found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n")), "embed-counts")
    joined = connected_components(found.where("b is not null").select("a", "b"), "embed-cc")
    # written on both sides of the joins, so that Spark can split a component with very many members
    places = coded.select("node", "first_id", "copies").join(joined, "node", "left").join(counts, "node", "left")
    places = settle(places.select("node", "first_id", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "embed-places")
    least_id = settle(places.groupBy("component").agg(F.min("first_id").alias("component_id")), "embed-least")
    info = coded.select("node", F.col("label").alias("l2"), F.col("v").alias("v2")).join(places.join(least_id, "component").select("node", "n_links", "component_id"), "node")
    info = info.withColumn("h2", F.xxhash64("l2", "v2"))
    mine = good.withColumn("h", F.xxhash64("label", "v"))
    full = mine.join(info, (F.col("h") == F.col("h2")) & (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")))
    out = full.select("vec_id", "n_links", "component_id")
    rest = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
