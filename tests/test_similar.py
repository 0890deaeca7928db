"""Thresholded neighbours by pivots: the same as all pairs, on odd input too, with fewer pairs looked at."""

import numpy as np
import pytest

from stancelake.operators import retrieval


def brute(rows, seeds, least, k):
    out = set()
    for i, g, v in seeds:
        found = []
        for j, h, w in rows:
            if j != i and g == h and len(v) == len(w):
                c = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
                if c >= least:
                    found.append((-c, j))
        out |= {(i, j, r) for r, (_, j) in enumerate(sorted(found)[:k], 1)}
    return out


def made(rng, n, spread, dim=12, centres=9):
    c = rng.normal(size=(centres, dim))
    return [(i, "ab"[i % 2], (c[rng.integers(centres)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread,least,fewer", [(0.15, 0.9, 0.5), (0.6, 0.75, 1.0), (5.0, 0.3, 1.0), (0.3, -0.2, 1.0)])
def test_pivots_lose_nothing(spark, spread, least, fewer):
    rows = made(np.random.default_rng(3), 300, spread)
    rows += [(1000 + i, "a", [1.0 + i, 2.0, -1.0]) for i in range(3)]
    odd = [(2000, None, [1.0] * 12), (2001, "a", [0.0] * 12), (2002, "a", None), (2003, "b", [float("nan")] * 12), (2004, "b", [1.0, None]), (2005, "a", []), (2006, "a", [float("inf")] + [1.0] * 11)]
    df = spark.createDataFrame(rows + odd, "vec_id long, label string, embedding array<double>")
    out, effort = retrieval.similar(df, df, least, 5, by="label", block=40, seed_block=30, pivots=16)
    assert {(r.source, r.target, r["rank"]) for r in out.collect()} == brute(rows, rows, least, 5)
    e = effort.first()
    assert 0 < e.compared <= fewer * e.pairs


def test_all_links_of_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(20)], "vec_id long, embedding array<double>")
    out, _ = retrieval.similar(df, df, 0.99, 3, block=4, seed_block=3)
    assert {(r.source, r.target) for r in out.collect()} == {(i, j) for i in range(20) for j in [x for x in range(4) if x != i][:3]}
    none, effort = retrieval.similar(df.limit(0), df.limit(0), 0.9)
    assert none.count() == 0 and effort.first().pairs == 0


def test_ranks_are_those_of_duckdb_where_cosines_nearly_tie(spark):
    import duckdb

    rng = np.random.default_rng(5)
    base = rng.uniform(0, 5e5, (60, 5)).round(2)
    base[20:40] *= np.eye(5)[rng.integers(0, 5, 20)]
    rows = [(i, (base[i % 60] * (1 + i // 60)).round(2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out, _ = retrieval.similar(df, df, 0.98, 5, block=70, seed_block=50)
    got = sorted((r.source, r.target, r["rank"]) for r in out.collect())
    v = df.toArrow()  # noqa: F841
    want = duckdb.sql("SELECT a.vec_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding, b.embedding) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding, b.embedding) >= 0.98 QUALIFY r <= 5").fetchall()
    assert got == sorted(want)


def test_seeds_carry_no_ranges_and_vectors_are_read_once(spark, monkeypatch):
    made_of, settle = {}, retrieval.settle

    def told(df, name):
        made_of.setdefault(name, []).append(df.columns)
        return settle(df, name)

    monkeypatch.setattr(retrieval, "settle", told)
    df = spark.createDataFrame(made(np.random.default_rng(4), 200, 0.2), "vec_id long, label string, embedding array<double>")
    _, effort = retrieval.similar(df, df, 0.9, 5, by="label", pivots=8)
    assert "parts" not in {c for tables in made_of.values() for t in tables for c in t} and "part" in made_of["similar-parts"][0]
    assert "similar-seeds" not in made_of and effort.first().pairs == 2 * 100 * 100


def test_profiles_are_summed_in_the_order_of_keys_however_the_table_is_split(spark, monkeypatch, tmp_path):
    from stancelake.plans import lookup

    r = np.random.default_rng(8)
    rows = [(k, k % 7, float(r.choice([1e16, -1e16, 0.37, 5.11, 1.0])), f"{1 + k % 2}-X") for k in range(400)]
    spark.createDataFrame([(c, "A") for c in range(7)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    mixed = [rows[i] for i in r.permutation(len(rows))]
    spark.createDataFrame(mixed, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").repartition(9).write.parquet(f"{tmp_path}/orders.parquet")
    want = {c: [0.0] * 5 for c in range(7)}
    for _, c, price, priority in rows:
        want[c][int(priority[0]) - 1] += price
    seen = []
    monkeypatch.setattr(lookup.retrieval, "similar", lambda v, *_: seen.append(v))
    lookup._alike(spark, str(tmp_path))
    assert {r.o_custkey: r.e for r in seen[0].collect()} == want
