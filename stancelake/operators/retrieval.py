"""Hybrid retrieval: filter, two ranked lists, reciprocal-rank fusion.

Filters come before both limits, so that a selective filter can't starve the
result. All orders are total (ties by id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake.tables import settle

RRF_K, CANDIDATES = 60, 3
#: Rows and seeds of a group that meet in one task.
BLOCK, SEED_BLOCK = 16_384, 4096
#: Pairs whose similarity is worked out at once.
PAIRS = 1 << 17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as rounded, and what rounding left out."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = a * 134217729.0
    high = t - (t - a)
    return high, a - high


def fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c with one rounding, by error-free sums and rounding to odd (Boldo and Melquiond)."""
    product = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    low = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    high, rest = _two_sum(c, low)
    top, left = _two_sum(product, high)
    odd, lost = _two_sum(rest, left)
    odd = np.where((lost != 0) & (odd.view(np.int64) & 1 == 0), np.nextafter(odd, np.copysign(np.inf, lost)), odd)
    return top + odd


def fused_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The scalar product of each row of a with that of b, place after place and each step fused, as DuckDB has it; plain where that overflows."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            total = fused(a[:, j], b[:, j], total)
        return np.where(np.isfinite(total), total, (a * b).sum(axis=1))


def fused_cosine(a: np.ndarray, b: np.ndarray, aa: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """Cosines of rows with the squares aa and bb of their lengths, in the steps of list_cosine_similarity; -1 to 1."""
    with np.errstate(all="ignore"):
        square = aa * bb
        length = np.where((square > 1e-290) & np.isfinite(square), np.sqrt(square), np.sqrt(aa) * np.sqrt(bb))
        return np.clip(fused_dot(a, b) / length, -1, 1)


def _doubles(v: str) -> Column:
    return F.col(v).cast("array<double>")


def rank(df: DataFrame, order: list, name: str, limit: int) -> DataFrame:
    """The first `limit` rows with their 1-based rank: a bounded heap a task, then a window over `limit` rows."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def vector_top(df: DataFrame, query: list[float], limit: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest rows by cosine; rows without a usable vector are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("similarity", cosine(_doubles(vector), q)).where(F.col("similarity").isNotNull())
    return rank(scored, [F.desc("similarity"), F.col(id_col)], "semantic_rank", limit)


def keyword_top(df: DataFrame, words: list[str], limit: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that hold every word, by how often they hold them.

    Words are runs of ASCII letters in lower case, without stemming or stop
    words; the score is the sum of counts (a choice of our own: fusion uses
    ranks alone).
    """
    q = [w.lower() for w in words]
    low = F.lower(text)
    has = df
    for w in q:  # cheap, and most rows end here
        has = has.where(low.contains(w))
    has = has.withColumn("__t", F.split(low, "[^a-z]+"))
    for w in q:
        has = has.where(F.array_contains("__t", w))
    score = sum((F.size(F.filter("__t", _same(w))) for w in q), F.lit(0))
    return rank(has.withColumn("keyword_score", score.cast("long")).drop("__t"), [F.desc("keyword_score"), F.col(id_col)], "keyword_rank", limit)


def _same(w: str):
    return lambda x: x == w


def fuse(semantic: DataFrame, keyword: DataFrame, limit: int, id_col: str = "id", k: int = RRF_K) -> DataFrame:
    """id, both ranks and the fused score: a full outer join of the two lists."""
    s = semantic.select(F.col(id_col), "semantic_rank")
    w = keyword.select(F.col(id_col), "keyword_rank")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = s.join(w, id_col, "full_outer").withColumn("rrf_score", F.floor((part("semantic_rank") + part("keyword_rank")) * 1_000_000 + 0.5) / 1_000_000.0)
    return both.orderBy(F.desc("rrf_score"), id_col).limit(limit)


def neighbours(vectors: DataFrame, seeds: DataFrame, least: float = 0.75, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", by: str | None = None, block: int = BLOCK, seed_block: int = SEED_BLOCK) -> DataFrame:
    """(source, target, rank, similarity): the k most similar rows of each seed, at `least` or more.

    seeds is a stated query set; with `by`, only rows of one group meet. Rows
    and seeds of a group are dealt to blocks, a pair of blocks is a task that
    gives k rows a seed, and these are merged: no pairs are shuffled. Vectors
    without length, or of another dimension than the seed's, are left out.
    """
    key = ["g", "dim"]
    return _ranked(_met(_usable(vectors, id_col, vector, by), _usable(seeds, id_col, vector, by), key, least, k, block, seed_block), k)


def _usable(df: DataFrame, id_col: str, vector: str, by: str | None) -> DataFrame:
    """(g, id, v, dim) of the rows with a group and a vector that has a length."""
    group = F.col(by).cast("string") if by else F.lit("")
    rows = df.select(group.alias("g"), F.col(id_col).cast("long").alias("id"), _doubles(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("g").isNotNull() & F.exists("v", lambda x: x != 0) & fine).withColumn("dim", F.size("v"))


def _ranked(met: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("similarity"), "target")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("source", "target", "rank", "similarity")


def _met(rows: DataFrame, asked: DataFrame, key: list[str], least: float, k: int, block: int, seed_block: int) -> DataFrame:
    """(source, target, similarity): k rows a seed from every pair of blocks of rows and seeds that share a key."""
    n = rows.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    n = n.join(asked.groupBy(*key).agg(F.ceil(F.count("*") / seed_block).cast("int").alias("s_blocks")), key)
    pick = lambda c: F.pmod(F.xxhash64("id", "v"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = rows.join(n, key).withColumn("b", pick("blocks")).select(*key, "b", spread("s_blocks").alias("s"), "id", "v")
    asked = asked.join(n, key).withColumn("s", pick("s_blocks")).select(*key, spread("blocks").alias("b"), "s", "id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            q, x = (np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(t.num_rows, -1) for t in (left, right))
            q_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            lengths, squares = np.sqrt((x * x).sum(axis=1)), fused_dot(x, x)
            for at in range(0, len(q), 256):
                some = q[at : at + 256]
                near = (some @ x.T) / (np.sqrt((some**2).sum(axis=1))[:, None] * lengths[None, :])
                near[q_ids[at : at + 256][:, None] == ids[None, :]] = -2
                m = min(k, len(x))
                kth = np.maximum(np.partition(near, len(x) - m, axis=1)[:, len(x) - m], least) - 1e-12
                i, c = np.nonzero(near >= kth[:, None])
                own = fused_dot(some, some)
                parts = [fused_cosine(some[i[s : s + PAIRS]], x[c[s : s + PAIRS]], own[i[s : s + PAIRS]], squares[c[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
                exact = np.concatenate(parts) if parts else np.zeros(0)
                order = np.lexsort((ids[c], -exact, i))
                order = order[exact[order] >= least]
                i, c, exact = i[order], c[order], exact[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                for column, values in zip(out, (q_ids[at + i[first]], ids[c[first]], exact[first]), strict=True):
                    column.append(values)
        source, target, similarity = (np.concatenate(o) if o else np.zeros(0) for o in out)
        return pa.table({"source": pa.array(source.astype(np.int64)), "target": pa.array(target.astype(np.int64)), "similarity": pa.array(similarity.astype(np.float64))})

    at = [*key, "s", "b"]
    return asked.groupBy(*at).cogroup(rows.groupBy(*at)).applyInArrow(meet, "source long, target long, similarity double")

#: Pivots at most, and the bounded sample that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 64, 4096


def pivots_of(rows: DataFrame, most: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """For each length of vectors, up to `most` unit vectors far apart, of the `sample` rows with the smallest hashes."""
    drawn = rows.select("v", F.xxhash64("v").alias("h")).orderBy("h", "v").limit(sample).collect()  # `sample` vectors at most
    out = {}
    for dim in {len(r["v"]) for r in drawn}:
        x = np.array([r["v"] for r in drawn if len(r["v"]) == dim], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(most, len(x)) and near.min() < 1 - 1e-9:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[dim] = x[chosen]
    return out


def _angles(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with `angles` to every pivot of their dimension, and `part`, the nearest one; empty and -1 where there is none."""

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(dims)[:-1]]).astype(np.int64)
            flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            sizes, part, values = np.zeros(len(dims), dtype=np.int32), np.full(len(dims), -1, dtype=np.int32), []
            own = {}
            for dim in np.unique(dims):
                p = pivots.get(int(dim))
                if p is None:
                    continue
                i = np.flatnonzero(dims == dim)
                x = flat[starts[i][:, None] + np.arange(dim)]
                x /= np.abs(x).max(axis=1, keepdims=True)
                a = np.arccos(np.clip((x @ p.T) / np.sqrt((x * x).sum(axis=1, keepdims=True)), -1, 1))
                sizes[i], part[i], own[int(dim)] = len(p), a.argmin(axis=1), (i, a)
            bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = np.zeros(bounds[-1])
            for i, a in own.values():
                values[bounds[i][:, None] + np.arange(a.shape[1])] = a
            angles = pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, angles, pa.array(part)], names=[*batch.schema.names, "angles", "part"])

    return rows.mapInArrow(run, "g string, id long, v array<double>, dim int, angles array<double>, part int")


def _widest(tables, low: str, high: str, n: str | None) -> pa.Table:
    """For each (g, dim, part): the least of `low` and the greatest of `high`, place by place, and how many rows (or the sum of n)."""
    held: dict[tuple, list] = {}
    for t in tables:
        key = list(zip(t.column("g").to_pylist(), t.column("dim").to_pylist(), t.column("part").to_pylist(), strict=True))
        where: dict[tuple, list] = {}
        for i, k in enumerate(key):
            where.setdefault(k, []).append(i)
        bottom, top = t.column(low), t.column(high)
        counts = t.column(n).to_pylist() if n else None
        for k, i in where.items():
            rows = pa.array(i)
            a, b = (np.asarray(c.take(rows).flatten() if isinstance(c, pa.Array) else c.combine_chunks().take(rows).flatten(), dtype=np.float64).reshape(len(i), -1) for c in (bottom, top))
            new = [a.min(axis=0), b.max(axis=0), sum(counts[j] for j in i) if counts else len(i)]
            if k in held:
                was = held[k]
                new = [np.minimum(was[0], new[0]), np.maximum(was[1], new[1]), was[2] + new[2]]
            held[k] = new
    lists = lambda j: pa.array([x[j].tolist() for x in held.values()], pa.list_(pa.float64()))
    columns = [pa.array([k[j] for k in held], t) for j, t in ((0, pa.string()), (1, pa.int32()), (2, pa.int32()))]
    return pa.table([*columns, lists(0), lists(1), pa.array([x[2] for x in held.values()], pa.int64())], names=["g", "dim", "part", "low", "high", "n"])


def _spans(rows: DataFrame) -> DataFrame:
    """(g, dim, part, low, high, n): a part's ranges of angles to every pivot; a task hands on a row a part."""
    schema = "g string, dim int, part int, low array<double>, high array<double>, n long"

    def own(batches):
        yield from _widest(batches, "angles", "angles", None).to_batches()

    def add(key: tuple, some: pa.Table) -> pa.Table:
        return _widest([some], "low", "high", "n")

    return rows.select("g", "dim", "part", "angles").mapInArrow(own, schema).groupBy("g", "dim", "part").applyInArrow(add, schema)


def _parts_met(asked: DataFrame, parts: DataFrame, reach: float) -> DataFrame:
    """(g, dim, id, v, n, compared, met): of the parts of a seed's group, which hold n rows, those that may hold a link, and how many rows they have.

    Seeds meet their group's parts in blocks: no seed carries the ranges with it.
    """

    def run(seeds: pa.Table, parts: pa.Table) -> pa.Table:
        met = [np.zeros(0, dtype=np.int32)]
        sizes, compared = np.zeros(seeds.num_rows, dtype=np.int64), np.zeros(seeds.num_rows, dtype=np.int64)
        if seeds.num_rows and parts.num_rows:
            part, n = parts.column("part").to_numpy(), parts.column("n").to_numpy()
            low, high = (np.asarray(parts.column(c).combine_chunks().flatten(), dtype=np.float64).reshape(len(part), -1) for c in ("low", "high"))
            angles = np.asarray(seeds.column("angles").combine_chunks().flatten(), dtype=np.float64).reshape(seeds.num_rows, -1)
            for at in range(0, len(angles), 4096):
                a = angles[at : at + 4096]
                near = np.ones((len(a), len(part)), dtype=bool)
                for j in range(low.shape[1]):
                    near &= (a[:, j, None] >= low[None, :, j] - reach) & (a[:, j, None] <= high[None, :, j] + reach)
                sizes[at : at + 4096], compared[at : at + 4096] = near.sum(axis=1), near @ n
                met.append(np.broadcast_to(part, near.shape)[near].astype(np.int32))
        total = int(parts.column("n").to_numpy().sum()) if parts.num_rows else 0
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(met)))
        columns = [*(seeds.column(c) for c in ("g", "dim", "id", "v")), pa.array(np.full(seeds.num_rows, total)), pa.array(compared), lists]
        return pa.table(columns, names=["g", "dim", "id", "v", "n", "compared", "met"]).slice(0, seeds.num_rows if parts.num_rows else 0)

    key = ["g", "dim", "block"]
    blocks = asked.groupBy("g", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = asked.join(blocks, ["g", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    spread = parts.join(blocks, ["g", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = "g string, dim int, id long, v array<double>, n long, compared long, met array<int>"
    return each.select(*key, "id", "v", "angles").groupBy(*key).cogroup(spread.select(*key, "part", "low", "high", "n").groupBy(*key)).applyInArrow(run, schema)


def similar(vectors: DataFrame, seeds: DataFrame, least: float = 0.75, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", by: str | None = None, block: int = BLOCK, seed_block: int = SEED_BLOCK, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """As neighbours, for seeds that may be all rows; and (compared, pairs), how many pairs were looked at of all.

    Every row lies in the part of its nearest pivot. Angles obey the triangle
    inequality, so a seed meets a part only if, for every pivot, its angle to
    that pivot is within arccos(least) of the range of the part's angles to it;
    all other parts hold nothing at `least`, and no link is lost. Equal inputs
    give equal parts; rows of a dimension without a pivot are one part that is
    always met. Where vectors point everywhere, angles hardly differ and little
    is left out: the counts tell. Both results come from written tables.
    """
    reach = float(np.arccos(min(1.0, max(-1.0, least)))) + 1e-6
    usable = settle(_usable(vectors, id_col, vector, by), "similar-vectors")
    at = pivots_of(usable, pivots)
    rows = settle(_angles(usable, at), "similar-rows")
    parts = settle(_spans(rows), "similar-parts")  # a row a part, `pivots` of them a group at most
    asked = rows if seeds is vectors else settle(_angles(_usable(seeds, id_col, vector, by), at), "similar-seeds")
    asked = settle(_parts_met(asked, parts, reach), "similar-met")
    effort = asked.agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    each = asked.select("g", "dim", "id", "v", F.explode("met").alias("part"))
    key = ["g", "dim", "part"]
    return _ranked(_met(rows.select(*key, "id", "v"), each, key, least, k, block, seed_block), k), effort


def citable_split(hits: DataFrame, include_fallback: bool = False) -> DataFrame:
    """hits with `is_citable`, and the places of those that are (1-based, by score, ties by id), counted by range."""
    from stancelake.operators.filters import citable
    from stancelake.operators.graph import running

    marked = hits.withColumn("is_citable", citable(F.col("annotation_source"), F.col("untrusted"), include_fallback))
    rows = marked.select("*", (-F.col("rrf_score")).alias("__down"), F.col("is_citable").cast("long").alias("__one"))
    placed = running(rows, ["__down", "id"], ["__one"], "citations")
    return placed.withColumn("citation", F.when(F.col("is_citable"), F.col("run___one").cast("int"))).select(*hits.columns, "is_citable", "citation")


def cited(numbers: DataFrame, split: DataFrame, number: str = "number") -> DataFrame:
    """numbers with the id of the hit that each cites; numbers that are none of the citable places are dropped."""
    places = split.where("is_citable").select(F.col("citation").cast("long").alias("__at"), F.col("id").alias("cited_id"))
    return numbers.join(places, F.col(number).cast("long") == F.col("__at")).drop("__at")
