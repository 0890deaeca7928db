"""Answers are asked for once, kept, and taken up after a failure or a stop."""

import random

import pytest

from stancelake.operators import annotation as an

SCHEMA = "clause_id string, section_id string, idx long, ctext string"


def clauses(spark, n):
    return spark.createDataFrame([(f"c{i}", "s", i, f"Text {i}.") for i in range(n)], SCHEMA).repartition(4)


def counted(folder, answer):
    """An annotator that notes every text it sees in a file of its own."""

    def call(texts):
        (folder / f"{random.random()}").write_text("\n".join(texts))
        return [answer(t) for t in texts]

    return call


def seen(folder):
    return [line for f in folder.iterdir() for line in f.read_text().split("\n")]


def drawn(_):
    """A model that varies: its three answers belong together."""
    k = random.randrange(3)
    return (("declarative", "imperative", "interrogative")[k], k / 10, k / 10, "unmarked")


def test_payloads_ask_once_and_keep_answers_together(spark, tmp_path):
    c = clauses(spark, 90)
    p = an.payloads(c, an.annotate(c, counted(tmp_path, drawn)))
    rows = p.collect() + p.collect()  # reading twice asks nobody
    assert sorted(seen(tmp_path)) == sorted(f"Text {i}." for i in range(90))
    assert all(r.modality == r.tenor == ("declarative", "imperative", "interrogative").index(r.mood) / 10 for r in rows)


def test_cached_asks_once(spark, tmp_path):
    c = clauses(spark, 50)
    empty = c.limit(0).selectExpr("section_id AS cache_key", "section_id AS mood", "section_id AS annotation_source")
    rows, add = an.cached(c, empty, counted(tmp_path, drawn))
    moods = {r.clause_id: r.mood for r in rows.collect()}
    assert len(seen(tmp_path)) == 50 == add.count() and len(moods) == 50
    again = tmp_path / "again"
    again.mkdir()
    hits, more = an.cached(c, add, counted(again, drawn))
    assert {r.clause_id: r.mood for r in hits.collect()} == moods and more.count() == 0 and seen(again) == []


def test_a_failed_run_is_taken_up(spark, tmp_path):
    c, notes, broken = clauses(spark, 100), tmp_path / "notes", tmp_path / "broken"
    notes.mkdir()
    broken.write_text("")

    def call(texts):
        if "Text 7." in texts and broken.exists():
            raise OSError("no answer")
        return counted(notes, drawn)(texts)

    with pytest.raises(Exception, match="no answer"):
        an.answered(c, [call], str(tmp_path / "base"), batch=5, at_once=4)
    broken.unlink()
    raw, whole = an.answered(c, [call], str(tmp_path / "base"), batch=5, at_once=4)
    assert whole and raw.count() == 100 == raw.select("clause_id").distinct().count()
    asked = seen(notes)
    assert set(asked) == {f"Text {i}." for i in range(100)} and len(asked) <= 100 + 4 * 5  # the round that failed, at most
    before = len(asked)
    same, _ = an.answered(c, [call], str(tmp_path / "base"), batch=5, at_once=4)
    assert len(seen(notes)) == before and sorted(map(tuple, same.collect())) == sorted(map(tuple, raw.collect()))


def test_stops_and_attempts(spark, tmp_path):
    c = clauses(spark, 60)
    asked = iter((False, False, True))
    first, second = tmp_path / "first", tmp_path / "second"
    first.mkdir()
    second.mkdir()
    odd = counted(first, lambda t: drawn(t) if int(t[5:-1]) % 2 else None)
    rest = counted(second, lambda t: drawn(t) if int(t[5:-1]) % 4 else None)
    raw, whole = an.answered(c, [odd, rest], str(tmp_path / "base"), batch=5, at_once=2, stop=lambda: next(asked))
    assert not whole and 0 < len(seen(first)) < 60 and seen(second) == []
    raw, whole = an.answered(c, [odd, rest], str(tmp_path / "base"), batch=5, at_once=2)
    assert whole and len(seen(first)) == 60 and len(seen(second)) == 30
    assert {r.clause_id: r.attempt for r in raw.collect()} == {f"c{i}": 0 if i % 2 else 1 for i in range(60) if i % 4}
    none, whole = an.answered(c.limit(0), [odd], str(tmp_path / "none"))
    assert whole and none.count() == 0


def test_files_hold_many_batches_and_calls_still_get_one(spark, tmp_path):
    sizes = tmp_path / "sizes"
    sizes.mkdir()

    def call(texts):
        (sizes / f"{random.random()}").write_text(str(len(texts)))
        return [None if t.endswith("7.") else ("declarative", 0.5, 0.5, t) for t in texts]

    raw, whole = an.answered(clauses(spark, 2000), [call, lambda texts: [("imperative", 0.5, 0.5, t) for t in texts]], str(tmp_path / "base"), batch=2)
    assert whole and {r.clause_id: r.attempt for r in raw.collect()} == {f"c{i}": int(i % 10 == 7) for i in range(2000)}
    assert len(list((tmp_path / "base/attempt=0/asked").glob("*.parquet"))) <= an.FILES + 4  # not one for each of 1,000 batches
    assert max(int(f.read_text()) for f in sizes.iterdir()) == 2
