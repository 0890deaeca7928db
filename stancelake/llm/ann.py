"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the k-nearest-neighbour graph is cut into parts of equal
size (recursive bisection along the main direction, then swaps that lower the
number of cut edges), and a small softmax classifier learns in which parts a
point's neighbours lie. Every row is put into its most probable part; a query
goes to its most probable parts, as many as points held out of the classifier
need to keep `TARGET` of their neighbours, and what it meets there is ranked
by exact distance.

Parts grow in proportion to the rows, `PART_ROWS` of them a part: where one
classifier of `FAN` parts isn't enough, every part is sampled, cut and learned
again, as often as it takes. So a fit is bounded at every level, and the
classifiers of a level are rows of a table that meets its part's rows.

Of rows with the very same vector only the k + 1 with the smallest ids can be
among the nearest of a query, so the others are dropped before anything meets.
Queries and rows meet by (part, block of queries, block of rows), so that a
part with very many of either is dealt to many tasks. A task returns k rows a
query.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stancelake.llm.common import settle
from stancelake.llm.embed_dedup import _valid

K = 10
#: Rows that a partition and its classifier are fitted on, at most: those with the smallest hashes.
SAMPLE = 8192
PART_ROWS, FAN = 1024, 64
GRAPH_K = 12
TARGET = 0.95
#: The share of a sample that is held out of its classifier, to count the parts that a query needs.
HELD_OUT = 0.125
QUERY_BLOCK, BLOCK = 4096, 16_384
#: Up to so many parts, a row for each of them is broadcast.
FEW_PARTS = 100_000


def fans(rows: int, part_rows: int = PART_ROWS, fan: int = FAN) -> list[int]:
    """Parts into which each part is cut, level by level: powers of two that make about rows / part_rows parts, 4 at least."""
    bits = max(2, round(np.log2(max(rows / part_rows, 1))))
    most = fan.bit_length() - 1
    levels = -(-bits // most)
    return [1 << (bits // levels + (i < bits % levels)) for i in range(levels)]


def neighbours(queries: np.ndarray, points: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """The k nearest points of each query, brute force in slices."""
    norms = (points * points).sum(axis=1)
    k = min(k, len(points) - skip_self)
    out = np.zeros((len(queries), k), dtype=np.int64)
    for at in range(0, len(queries), 512):
        d = norms[None, :] - 2 * queries[at : at + 512] @ points.T
        if skip_self:
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(x: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two halves of equal size (one apart if odd) that cut few of the edges (a, b)."""
    n = len(x)
    z = x - x.mean(axis=0)
    v = rng.standard_normal(x.shape[1])
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-300)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(z @ v, kind="stable")[n // 2 :]] = True
    best, best_cut = side, int((side[a] != side[b]).sum())
    step = max(1, n // 10)
    for _ in range(40):
        cross = np.where(side[a] != side[b], 1.0, -1.0)
        gain = np.bincount(a, weights=cross, minlength=n) + np.bincount(b, weights=cross, minlength=n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(step, len(one), len(two))
        m = int((gain[one[:m]] + gain[two[:m]] > 0).sum())
        if not m:
            break
        side = side.copy()
        side[one[:m]], side[two[:m]] = False, True
        cut = int((side[a] != side[b]).sum())
        if cut < best_cut:
            best, best_cut = side, cut
        else:
            side, step = best, step // 2
            if not step:
                break
    return best


def partition(x: np.ndarray, near: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Parts (a power of two of them) of equal size of the neighbour graph."""
    rng = np.random.default_rng(seed)
    n = len(x)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    part = np.zeros(n, dtype=np.int64)
    for _ in range(max(0, parts.bit_length() - 1)):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            inside = (at[a] >= 0) & (at[b] >= 0)
            new[own] += bisect(x[own], at[a[inside]], at[b[inside]], rng)
        part = new
    return part


class Router:
    """A softmax classifier over parts."""

    def __init__(self, mean: np.ndarray, scale: float, w: np.ndarray, b: np.ndarray, probes: int):
        self.mean, self.scale, self.w, self.b, self.probes = mean, scale, w, b, probes

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.logits(x).argmax(axis=1)

    def routes(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def fit(x: np.ndarray, parts: int, k: int = K, target: float = TARGET, seed: int = 0, epochs: int = 40) -> Router:
    """Partition a sample's graph, learn to route, and set the number of parts that a query needs."""
    n, d = x.shape
    if n < 2 * parts:  # fewer points than parts to speak of
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), 1)
    near = neighbours(x, x, GRAPH_K, True)
    part = partition(x, near, parts, seed)
    aim = np.zeros((n, parts))
    np.add.at(aim, (np.arange(n), part), 2.0)
    np.add.at(aim, (np.repeat(np.arange(n), near.shape[1]), part[near.ravel()]), 1.0)
    aim /= aim.sum(axis=1, keepdims=True)
    mean, scale = x.mean(axis=0), float(x.std()) or 1.0
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    held, learned = np.split(rng.permutation(n), [max(1, int(HELD_OUT * n))])
    w, b = np.zeros((d, parts)), np.zeros(parts)
    m, v, t = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)], 0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(learned), max(1, len(learned) // 256)):
            o = z[at] @ w + b
            p = np.exp(o - o.max(axis=1, keepdims=True))
            g = (p / p.sum(axis=1, keepdims=True) - aim[at]) / len(at)
            t += 1
            for i, (value, grad) in enumerate(((w, z[at].T @ g + 1e-5 * w), (b, g.sum(axis=0)))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                value -= 0.01 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-9)
    router = Router(mean, scale, w, b, parts)
    truth = neighbours(x, x, min(k, n - 1), True)[held]
    rank = np.argsort(router.routes(x[held]), axis=1)
    need = np.take_along_axis(rank, router.home(x)[truth], axis=1)  # how many parts each neighbour needs, less one
    recall = np.array([(need < p).mean() for p in range(1, parts + 1)])
    router.probes = int(np.flatnonzero(recall >= target)[0]) + 1
    return router


def nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's row, ids, distances) of its k nearest, exact in double precision, ties to the smaller id."""
    norms = (x * x).sum(axis=1)
    for at in range(0, len(q), 256):
        own = q[at : at + 256]
        d = norms[None, :] - 2 * own @ x.T + (own * own).sum(axis=1)[:, None]
        slack = 1e-9 * (norms.max(initial=0.0) + (own * own).sum(axis=1)) + 1e-300
        d[q_ids[at : at + 256][:, None] == ids[None, :]] = np.inf
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        for i in range(len(own)):
            c = np.flatnonzero((d[i] <= kth[i] + slack[i]) & np.isfinite(d[i]))
            if not len(c):
                continue
            exact = np.sqrt(((x[c] - own[i]) ** 2).sum(axis=1))
            first = np.lexsort((ids[c], exact))[:k]
            yield at + i, ids[c[first]], exact[first]


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(a.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)


def _of_parts(counts: DataFrame, made: int) -> DataFrame:
    """A table with a row for each of `made` parts at most, to be broadcast where they are few: rows of a hot part then stay in place."""
    return F.broadcast(counts) if made <= FEW_PARTS else counts


def _fitted(rows: DataFrame, made: int, parts: int, sample: int, target: float) -> DataFrame:
    """(part, model) for every part of rows: a classifier of the part's own sample, pickled."""
    order = F.xxhash64("vec_id", "v")
    # a hash below a bound that about 2 * sample rows of the part meet, so that no task reads more than those
    share = rows.groupBy("part").agg((2.0 * sample / F.count("*")).alias("share"))
    some = rows.join(_of_parts(share, made), "part").where(F.shiftrightunsigned(order, 1) / float(1 << 63) < F.col("share"))
    drawn = some.withColumn("_at", F.row_number().over(Window.partitionBy("part").orderBy(order, "vec_id"))).where(F.col("_at") <= sample)

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        model = pickle.dumps(fit(_matrix(t.column("v"), t.num_rows), parts, target=target, seed=abs(key[0].as_py()) % (1 << 31)))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "model": pa.array([model], pa.binary())})

    return drawn.select("part", "v", order.alias("o")).groupBy("part").applyInArrow(learn, "part long, model binary")


def _sent(rows: DataFrame, models: DataFrame, made: int, parts: int, block: int, all_routes: bool) -> DataFrame:
    """rows with the part that their part's classifier sends them to; with all_routes, with every part that a query needs."""
    counts = rows.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = rows.join(_of_parts(counts, made), "part").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int")).select("part", "block", "vec_id", "v")
    copies = models.join(counts, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "model")

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"part": pa.array([], pa.int64()), "vec_id": left.column("vec_id"), "v": left.column("v")})
        router, x = pickle.loads(right.column("model")[0].as_py()), _matrix(left.column("v"), left.num_rows)
        to = router.routes(x) if all_routes else router.home(x)[:, None]
        t = left.select(["vec_id", "v"]).take(pa.array(np.repeat(np.arange(len(x)), to.shape[1])))
        return t.add_column(0, "part", pa.array(key[0].as_py() * parts + to.ravel().astype(np.int64)))

    return dealt.groupBy("part", "block").cogroup(copies.groupBy("part", "block")).applyInArrow(send, "part long, vec_id long, v array<double>")


def search(
    vectors: DataFrame, every: int = 100, k: int = K, sample: int = SAMPLE, part_rows: int = PART_ROWS, fan: int = FAN, query_block: int = QUERY_BLOCK, block: int = BLOCK, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found.

    Queries are the rows whose id is divisible by `every`; candidates are all
    rows with another id. Null ids take no part, nor do vectors that are null,
    empty, zero or hold null or non-finite components. Vectors are near only
    to those of their own dimension; those of the commonest dimension go
    through learned parts, each other dimension is one part. Rows that repeat a query's id
    and vector give one list, rows that repeat an id with other vectors one
    together; repeated candidates count each. Ties go to the smaller id. An
    empty table gives no rows; other columns aren't read, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(_valid(F.col("v")) & F.col("vec_id").isNotNull())
    # of equal vectors, the k + 1 smallest ids: the limit of the window applies before its shuffle
    first = F.row_number().over(Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id"))
    points = settle(rows.withColumn("_n", first).where(F.col("_n") <= k + 1).select(F.lit(0).cast("long").alias("part"), "vec_id", "v"), "ann-points")
    dims = points.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).collect()  # a row a dimension
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    main, n = dims[0]["dim"], dims[0]["count"]
    asked = settle(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]).select(F.lit(0).cast("long").alias("part"), "vec_id", "v"), "ann-asked")
    levels = fans(n, part_rows, fan)
    inside, queries = points.where(F.size("v") == main), asked.where(F.size("v") == main)
    made = 1
    for level, parts in enumerate(levels):
        models = settle(_fitted(inside, made, parts, sample, target ** (1 / len(levels))), f"ann-models-{level}")
        inside = settle(_sent(inside, models, made, parts, block, False), f"ann-points-{level}")
        queries = settle(_sent(queries, models, made, parts, block, True), f"ann-queries-{level}")
        made *= parts
    if len(dims) > 1:
        alone = lambda df: df.where(F.size("v") != main).select((-F.size("v")).cast("long").alias("part"), "vec_id", "v")
        inside, queries = inside.unionByName(alone(points)), queries.unionByName(alone(asked))
    counts = inside.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    counts = settle(counts.join(queries.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("q_blocks")), "part"), "ann-parts")
    counts = _of_parts(counts, made + len(dims))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pick = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    queries = queries.join(counts, "part").withColumn("q", pick("q_blocks")).select("part", "q", spread("blocks").alias("p"), "vec_id", "v")
    inside = inside.join(counts, "part").withColumn("p", pick("blocks")).select("part", spread("q_blocks").alias("q"), "p", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            q_ids, ids = left.column("vec_id").to_numpy(), right.column("vec_id").to_numpy()
            for i, got, far in nearest(_matrix(left.column("v"), len(q_ids)), q_ids, _matrix(right.column("v"), len(ids)), ids, k):
                out[0].extend([int(q_ids[i])] * len(got))
                out[1].extend(got.tolist())
                out[2].extend(far.tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    met = queries.groupBy("part", "q", "p").cogroup(inside.groupBy("part", "q", "p")).applyInArrow(meet, "query_id long, vec_id long, score double")
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
