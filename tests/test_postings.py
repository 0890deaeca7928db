"""The inverted index against a scan, in plain Python and on the tables."""

import random
import re
import threading
import unicodedata

import pytest
from pyspark.sql import functions as F

from stancelake.commits import Log
from stancelake.operators import postings as po


def words(text):
    out, cur = [], ""
    for c in (text or "").lower():
        if unicodedata.category(c)[0] in "LN":
            cur += c
        else:
            out, cur = out + [cur], ""
    return [w for w in [*out, cur] if w]


def scan(docs, question, k):
    asked = set(words(question))
    hits = [(-sum(words(t).count(w) for w in asked), i) for i, t in docs.items() if asked and asked <= set(words(t))]
    return [(r, i, -s) for r, (s, i) in enumerate(sorted(hits)[:k], 1)]


def some_docs(seed, n):
    r = random.Random(seed)
    vocabulary = ["straße", "Straße", "été", "naïve", "the", "the", "the", "of", "日本", "x1", "don't", "ÅNGSTRÖM"]
    return {i: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 30))) + r.choice([".", "", " -- ", "\n"]) for i in r.sample(range(10_000), n)}


@pytest.mark.parametrize(("shard", "block"), [(50_000, 128), (60, 4), (1000, 1)])
def test_search_equals_scan(spark, shard, block):
    docs = some_docs(1, 300)
    df = spark.createDataFrame([*docs.items(), (None, "the")], "id long, text string")
    named = po.numbered(df, "id", size=shard).cache()
    index = po.postings(named, block).cache()
    assert index.groupBy("shard", "word").agg(F.sum("n").alias("n")).groupBy().agg(F.sum("n")).first()[0] == sum(len(set(words(t))) for t in docs.values())
    asked = ["the", "STRASSE straße", "été naïve", "the of 日本 x1", "ångström", "don t", "", "missing the", "x1!"]
    for k in (1, 5, 1000):
        found, _ = po.search(index, named, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string"), k)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
        assert got == {i: s for i, q in enumerate(asked) if (s := scan(docs, q, k))}


def test_blocks_are_pruned(spark):
    """One block holds the best hits; the others can't reach them and stay closed."""
    docs = {i: "often " * (9 if i < 128 else 1) + "rare" for i in range(5000)}
    named = po.numbered(spark.createDataFrame(list(docs.items()), "id long, text string"), "id").cache()
    found, effort = po.search(po.postings(named), named, spark.createDataFrame([(1, "often rare")], "query_id int, text string"), 10)
    assert [r.id for r in found.orderBy("rank").collect()] == list(range(10))
    e = effort.first()
    assert e.held == 10_000 and e.read <= 4 * 128


def test_index_goes_with_the_table(spark, tmp_path):
    log = Log(spark, str(tmp_path), buckets=4)
    put = lambda rows: log.commit(lambda t: po.store(t, "clauses", spark.createDataFrame(rows, "section string, clause string, ctext string"), "section", "clause", "ctext"))

    def find(text):
        found, _ = po.search(log.read("clauses_postings"), log.read("clauses_names"), spark.createDataFrame([(1, text)], "query_id int, text string"), 50)
        return [r.id for r in found.orderBy("rank").collect()]

    put([(f"s{i}", f"s{i}:{j}", f"word{i} shared {'more ' * j}") for i in range(12) for j in range(2)])
    assert len(find("shared")) == 24 and find("more shared")[:1] == ["s0:1"] and find("word3") == ["s3:0", "s3:1"]
    put([("s3", "s3:0", "changed shared")])
    assert find("word3") == [] and find("changed") == ["s3:0"] and len(find("shared")) == 23
    jobs = [threading.Thread(target=put, args=([(s, f"{s}:0", f"twice {s}")],)) for s in ("s5", "s6", "s7")]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert find("twice") == ["s5:0", "s6:0", "s7:0"] and len(find("shared")) == 17
    assert log.read("clauses_names").count() == log.read("clauses").count() == log.read("clauses_names").select("shard", "number").distinct().count()


def test_nothing(spark):
    named = po.numbered(spark.createDataFrame([], "id long, text string"), "id")
    found, effort = po.search(po.postings(named), named, spark.createDataFrame([(1, "x")], "query_id int, text string"), 3)
    assert found.count() == effort.count() == 0
    assert re.fullmatch(r"\d+", str(po.SHARD))


def test_texts_are_not_sorted_to_number_documents(spark):
    docs = spark.createDataFrame([(3, "c"), (1, "b"), (1, "a"), (None, "x"), (2, None)], "doc_id long, text string")
    out = po.numbered(docs, "doc_id")
    assert sorted((r.number, r.id, r.text) for r in out.collect()) == [(1, 1, "a"), (2, 2, ""), (3, 3, "c")]
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, x in enumerate(lines) if "Window [" in x)
    depth = lambda x: len(x) - len(x.lstrip(" :+-|"))
    below = [x for n, x in enumerate(lines[at + 1 :]) if all(depth(y) > depth(lines[at]) for y in lines[at + 1 : at + 2 + n])]
    assert not any("min(" in x for x in below)


def test_effort_asks_for_all_words_of_a_question(spark, tmp_path):
    from stancelake.plans import lookup

    spark.createDataFrame([(i, f"alpha beta {'gamma ' * (i % 3)} delta{i % 5} Émile") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, "alpha beta gamma delta1 émile"), (2, "Alpha alpha absent"), (3, "absent only"), (4, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    for name, short in (("documents", "d"), ("benchmark", "b")):
        next(tmp_path.joinpath(short).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = {r.query_id: r.held for r in lookup.search_effort(spark, str(tmp_path)).collect()}
    assert got == {1: 40 + 40 + 26 + 8 + 40, 2: 40}


def test_a_block_is_sent_once_for_many_questions(spark, monkeypatch):
    """Of a shard, each part of the questions gets the blocks of its words once."""
    docs = po.numbered(spark.createDataFrame([(i, "often also") for i in range(300)], "id long, text string"), "id").cache()
    monkeypatch.setattr(po, "SLICES", 1)
    seen = []
    settle = po.settle
    monkeypatch.setattr(po, "settle", lambda df, name: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or settle(df, name))
    found, effort = po.search(po.postings(docs), docs, spark.createDataFrame([(i, "often also") for i in range(20)], "query_id int, text string"), 3)
    assert [r.held for r in effort.collect()] == [600] * 20 and found.count() == 60
    grouped = next(x for x in seen[0].split("\n") if "FlatMapGroupsInArrow" in x)
    assert "query_id" not in grouped.split("meet(")[0]
