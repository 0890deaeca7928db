"""Interval labels, paths, owners, sums and the guard of writes, against walks in plain Python."""

import random

import pytest

from stancelake.commits import Log
from stancelake.operators import graph


def forest(seed, n, deep=False):
    r = random.Random(seed)
    return {i: (r.choice([None, i - 1] if deep and i > 1 and r.random() < 0.05 else [i - 1]) if deep and i else (r.randrange(i) if i and r.random() < 0.95 else None)) for i in range(n)}


def frame(spark, parents):
    return spark.createDataFrame([(k, v, f"l{k}") for k, v in parents.items()], "node long, parent long, label string")


def chain(parents, k):
    out = []
    while k is not None:
        out.append(k)
        k = parents.get(k)
    return out


@pytest.mark.parametrize("deep", [False, True])
def test_intervals_hold_what_stands_below(spark, deep):
    parents = forest(1, 120, deep)
    rows = {r.node: r for r in graph.intervals(frame(spark, parents)).collect()}
    assert set(rows) == set(parents)
    for k in parents:
        way = chain(parents, k)
        assert (rows[k].root, rows[k].depth, rows[k].parent) == (way[-1], len(way) - 1, parents[k])
        below = {m for m in parents if rows[m].root == rows[k].root and rows[k].pre <= rows[m].pre and rows[m].post <= rows[k].post}
        assert below == {m for m in parents if k in chain(parents, m)}
        assert rows[k].post - rows[k].pre == 2 * len(below) - 1


def test_a_parent_without_a_row_and_odd_edges(spark):
    e = spark.createDataFrame([(2, 1), (3, 1), (3, 1), (None, 1), (5, None)], "node long, parent long")
    assert sorted((r.node, r.root, r.depth) for r in graph.intervals(e).collect()) == [(1, 1, 0), (2, 1, 1), (3, 1, 1), (5, 5, 0)]
    assert graph.intervals(e.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than one parent"):
        graph.intervals(spark.createDataFrame([(2, 1), (2, 3)], "node long, parent long"))
    with pytest.raises(ValueError, match="cycle"):
        graph.intervals(spark.createDataFrame([(2, 1), (1, 2), (3, 1)], "node long, parent long"))


@pytest.mark.parametrize("deep", [False, True])
def test_paths_owners_matching_selection(spark, deep):
    parents = forest(2, 90, deep)
    e = frame(spark, parents)
    r = random.Random(4)
    assert {(x.node, x.depth, x.path) for x in graph.paths(e, joiner="/").collect()} == {(k, len(chain(parents, k)) - 1, "/".join(f"l{m}" for m in reversed(chain(parents, k)))) for k in parents}
    texts = e.select("node", "label")
    assert {(x.node, x.evidence) for x in graph.widened(texts.where("node < 40"), e.drop("label").join(texts, "node"), "label").collect()} == {(k, " ".join(f"l{m}" for m in reversed(chain(parents, k)) if m < 40)) for k in parents if k < 40}
    marked = set(r.sample(sorted(parents), 15))
    kinds = spark.createDataFrame([(k, "yes" if k in marked else "no") for k in parents], "node long, kind string")
    want = {(k, next(m for m in chain(parents, k) if m in marked)) for k in parents if marked & set(chain(parents, k))}
    assert {tuple(x) for x in graph.owners(e, e.select("node"), kinds, "yes").collect()} == want
    hits = spark.createDataFrame([(k,) for k in marked], "node long")
    assert {x.node for x in graph.matching(e, hits).collect()} == {m for k in marked for m in chain(parents, k)}
    inner = {p for p in parents.values() if p is not None}
    on = {k for k in parents if k not in inner and marked & set(chain(parents, k))}
    below = {k: [m for m in parents if m not in inner and k in chain(parents, m)] for k in parents}
    want = {k: "full" if all(m in on for m in b) else "partial" if any(m in on for m in b) else "none" for k, b in below.items()}
    assert {x.node: x.state for x in graph.selection(e, hits).collect()} == want


def test_running_sums(spark):
    r = random.Random(0)
    rows = [(i, r.randrange(-5, 9)) for i in range(500)]
    r.shuffle(rows)
    got = {x.k: x.run_v for x in graph.running(spark.createDataFrame(rows, "k long, v long"), ["k"], ["v"]).collect()}
    total, want = 0, {}
    for k, v in sorted(rows):
        total += v
        want[k] = total
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_guard_refuses_what_stands_on_a_cycle(spark, seed):
    r = random.Random(seed)
    parents = forest(seed, 60, deep=seed == 1)
    moved = {k: r.choice([*range(60), 99]) for k in r.sample(range(60), 12)}
    after = parents | moved

    def on_cycle(k):
        at, seen = after.get(k), set()
        while at is not None and at not in seen:
            if at == k:
                return True
            seen.add(at)
            at = after.get(at)
        return False

    new = spark.createDataFrame([(k, v, "x") for k, v in moved.items()], "node long, parent long, note string")
    good, bad = graph.admitted(frame(spark, parents), new)
    assert {x.node for x in bad.collect()} == {k for k in moved if on_cycle(k)}
    assert {x.node for x in good.collect()} == {k for k in moved if not on_cycle(k)} and "note" in good.columns


def test_moves_are_checked_in_their_commit(spark, tmp_path):
    """Two moves that are harmless alone and close a cycle together: the later one is refused."""
    log = Log(spark, str(tmp_path), buckets=4)
    e = frame(spark, {1: None, 2: None, 3: 1, 4: 2}).select("node", "parent")
    log.commit(lambda t: t.append("tree", e, "node"))
    one = lambda a, b: spark.createDataFrame([(a, b)], "node long, parent long")
    seen = []

    def change(t):
        seen.append(t.number)
        graph.move(t, "tree", one(1, 4))
        if len(seen) == 1:
            log.commit(lambda u: graph.move(u, "tree", one(2, 3)))

    with pytest.raises(ValueError, match="cycle"):
        log.commit(change)
    assert len(seen) == 2 and {(r.node, r.parent) for r in log.read("tree").collect()} == {(1, None), (2, 3), (3, 1), (4, 2)}
    log.commit(lambda t: graph.move(t, "tree", one(2, None)))
    log.commit(lambda t: graph.move(t, "tree", one(1, 4)))
    assert {(r.node, r.parent) for r in log.read("tree").collect()} == {(1, 4), (2, None), (3, 1), (4, 2)}


def test_cycles_take_as_many_joins_as_tails_have_bits_and_no_broadcast(spark, monkeypatch):
    made = []
    settle = graph.settle

    def told(df, name):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return settle(df, name)

    monkeypatch.setattr(graph, "settle", told)
    r = random.Random(3)
    parents = {i: (i // 10 * 10 + (i + 1) % 5 if i % 10 < 5 else i - 1) for i in range(4000)}  # rings of five, tails of five
    parents |= {4000 + i: (3999 + i if i else None) for i in range(40)}  # a path to a root
    parents |= {5000: 5000, 5001: r.choice([5000, 4039])}
    got = {x.node for x in graph.cycles(frame(spark, parents)).collect()}
    assert got == {i for i in range(4000) if i % 10 < 5} | {5000}
    hops = [p for n, p in made if n == "graph-hop"]
    assert len(hops) <= 8 and not any("Broadcast" in p for p in hops)
    assert graph.cycles(frame(spark, {1: 2, 2: 3})).count() == 0 and graph.cycles(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_intervals_take_as_many_joins_as_the_depth_has_bits(spark, monkeypatch):
    steps, settle = [], graph.settle

    def told(df, name):
        steps.append(name)
        return settle(df, name)

    monkeypatch.setattr(graph, "settle", told)
    got = graph.intervals(frame(spark, {0: None, 1: 0, 2: 0} | {i: 1 + i % 2 for i in range(3, 300)})).collect()
    assert {r.node: r.depth for r in got} == {0: 0, 1: 1, 2: 1} | dict.fromkeys(range(3, 300), 2)
    assert sorted(x for r in got for x in (r.pre, r.post)) == list(range(-600, 0))
    assert steps.count("graph-tour") <= 3 and steps.count("graph-sizes") <= 3
