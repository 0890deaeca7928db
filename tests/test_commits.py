"""The commit log: whole commits or none, two writers at once, retries, retention."""

import threading

import pytest
from pyspark.sql import functions as F

from stancelake.commits import BUCKETS, Conflict, Log, bucket_of
from stancelake.plans.engine import Engine


def sections(spark, ids, text, n=2):
    return spark.createDataFrame([(f"s{i}", k, text) for i in ids for k in range(n)], "section_id string, idx long, ctext string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def at_once(*jobs):
    """Run jobs in threads; what they raised."""
    failed = []

    def run(job):
        try:
            job()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return failed


def test_versions_and_missing_tables(spark, tmp_path):
    log = Log(spark, str(tmp_path), buckets=4)
    assert log.read("clauses") is None and log.snapshot() == (0, {})
    assert log.commit(lambda t: None) == 0
    assert log.commit(lambda t: t.append("clauses", sections(spark, range(10), "old"), "section_id")) == 1
    old = log.read("clauses")
    assert log.commit(lambda t: t.replace("clauses", sections(spark, [3, 20], "new", 1))) == 2
    now = rows(log.read("clauses"))
    assert len(now) == 20 and ("s3", 0, "new") in now and ("s3", 1, "old") not in now and ("s20", 0, "new") in now
    assert len(rows(old)) == 20 == len(rows(log.read("clauses", 1))) and ("s3", 1, "old") in rows(old)  # a reader that has begun goes on
    log.commit(lambda t: t.remove("clauses", spark.createDataFrame([("s3",), ("s4",)], "section_id string")))
    assert {r[0] for r in rows(log.read("clauses"))} == {f"s{i}" for i in (0, 1, 2, 5, 6, 7, 8, 9, 20)}
    with pytest.raises(ValueError, match="kept by section_id"):
        log.commit(lambda t: t.append("clauses", sections(spark, [1], "x"), "idx"))
    with pytest.raises(KeyError):
        log.commit(lambda t: t.append("other", sections(spark, [1], "x")))
    assert [(r.number, r["name"]) for r in log.history().orderBy("number").collect()] == [(1, "clauses"), (2, "clauses"), (3, "clauses")]


def test_merge_takes_values_that_are_there(spark, tmp_path):
    log = Log(spark, str(tmp_path), buckets=4)
    log.commit(lambda t: t.append("c", sections(spark, range(4), "old"), "section_id"))
    fresh = spark.createDataFrame([("s1", 0, "new"), ("s2", 1, None)], "section_id string, idx long, ctext string")
    key = F.concat("section_id", F.col("idx").cast("string"))
    log.commit(lambda t: t.replace("c", t.read("c").withColumn("idx", F.col("idx") * 10)))  # reads what it writes
    log.commit(lambda t: t.merge("c", fresh.withColumn("idx", F.col("idx") * 10).where("section_id = 's1' and idx = 0").withColumn("section_id", F.lit("s1")), "section_id", ["ctext"]))
    assert [r for r in rows(log.read("c")) if r[0] == "s1"] == [("s1", 0, "new"), ("s1", 10, "new")]
    assert log.read("c").select(key).distinct().count() == 8


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_lose_nothing(spark, tmp_path, same):
    """Both begin on the same entry; with the same bucket the second runs again, with others it goes on top."""
    log = Log(spark, str(tmp_path), buckets=64)
    bucket = {r.id: r.b for r in spark.range(200).select("id", bucket_of(F.concat(F.lit("s"), F.col("id").cast("string")), 64).alias("b")).collect()}
    first = 0
    second = next(i for i in range(1, 200) if (bucket[i] == bucket[first]) == same)
    log.commit(lambda t: t.append("c", sections(spark, range(200), "old"), "section_id"))
    meet, runs = threading.Barrier(2), []

    def writer(i):
        def change(t):
            runs.append((i, t.number))
            t.replace("c", sections(spark, [i], f"new{i}", 1))
            if len([x for x in runs if x[0] == i]) == 1:
                meet.wait(60)

        return lambda: log.commit(change)

    assert at_once(writer(first), writer(second)) == []
    now = rows(log.read("c"))
    assert len(now) == 398 and (f"s{first}", 0, f"new{first}") in now and (f"s{second}", 0, f"new{second}") in now
    assert log.numbers() == [1, 2, 3]
    assert len(runs) == (3 if same else 2)


def test_appends_never_conflict_and_creation_happens_once(spark, tmp_path):
    logs = [Log(spark, str(tmp_path), buckets=2) for _ in range(4)]
    jobs = [lambda i=i, log=log: log.commit(lambda t: t.append("r", sections(spark, [i], "x", 1), "section_id")) for i, log in enumerate(logs)]
    assert at_once(*jobs) == []
    assert len(rows(logs[0].read("r"))) == 4 and logs[0].numbers() == [1, 2, 3, 4]


def test_a_read_holds_the_commit_to_the_whole_table(spark, tmp_path):
    log = Log(spark, str(tmp_path), buckets=8, tries=2)
    log.commit(lambda t: t.append("c", sections(spark, range(3), "old"), "section_id"))
    seen = []

    def change(t):
        seen.append(t.read("c").count())
        if len(seen) == 1:  # another writer comes between
            Log(spark, str(tmp_path)).commit(lambda u: u.append("c", sections(spark, [50], "x", 1)))
        t.append("totals", spark.createDataFrame([(1, seen[-1])], "id long, n long"), "id")

    log.commit(change)
    assert seen == [6, 7] and rows(log.read("totals")) == [(1, 7)]

    def always(t):
        t.read("c")
        Log(spark, str(tmp_path)).commit(lambda u: u.append("c", sections(spark, [51], "x", 1)))
        t.append("totals", spark.createDataFrame([(2, 0)], "id long, n long"), "id")

    with pytest.raises(Conflict):
        log.commit(always)
    assert rows(log.read("totals")) == [(1, 7)]


def test_a_crash_leaves_neither_payload_nor_review(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path))
    e.store(e.compile(spark.createDataFrame([("s#1", "It might rain. He must go!")], "section_id string, text string")))
    before = rows(e.read("clauses").select("clause_id", "annotation_source"))
    human = lambda c: c.withColumns({"mood": F.lit("imperative"), "annotation_source": F.lit("human")})
    with monkeypatch.context() as m:
        m.setattr(Log, "_put_if_absent", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            e.decide("s#1:0", "re_annotated", "2024-01-01", annotate=human)
    with pytest.raises(Exception, match="broken"):  # a file that can't be written
        e.log.commit(lambda t: t.append("clauses", e.read("clauses").withColumn("ctext", F.raise_error(F.lit("broken")).cast("string"))))
    assert rows(e.read("clauses").select("clause_id", "annotation_source")) == before and e.read("reviews") is None
    e.decide("s#1:0", "re_annotated", "2024-01-01", annotate=human)
    assert dict(rows(e.read("clauses").select("clause_id", "annotation_source")))["s#1:0"] == "human" and e.read("reviews").count() == 1
    assert len(e.log.numbers()) == 2  # payload and review are one commit


def test_two_reviews_at_once(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.store(e.compile(spark.createDataFrame([("s#1", "It might rain. He must go!"), ("s#2", "Well. Go on.")], "section_id string, text string")))
    human = lambda c: c.withColumn("annotation_source", F.lit("human"))
    jobs = [lambda i=i: Engine(spark, str(tmp_path)).decide(i, "re_annotated", "2024-01-01", annotate=human) for i in ("s#1:0", "s#1:1", "s#2:0")]
    assert at_once(*jobs) == []
    assert {r.clause_id for r in e.read("clauses").where("annotation_source = 'human'").collect()} == {"s#1:0", "s#1:1", "s#2:0"}
    assert e.read("reviews").count() == 3


def test_retention(spark, tmp_path):
    log = Log(spark, str(tmp_path), buckets=1)
    for i in range(4):
        log.commit(lambda t, i=i: t.replace("c", sections(spark, [1], f"v{i}"), "section_id"))
    assert log.tidy(keep=2) == 0  # young files may belong to a writer at work
    assert log.numbers() == [3, 4]
    assert log.tidy(keep=1, older_than_s=-60) == 3
    assert rows(log.read("c")) == [("s1", 0, "v3"), ("s1", 1, "v3")]
    assert BUCKETS >= 1
