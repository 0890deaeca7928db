"""Annotation contracts, digests and exports on rows written here."""

import json

import pytest
from pyspark.sql import functions as F

from stancelake.operators import annotation as an, digest as dg
from stancelake.sources import exports as ex


@pytest.fixture(scope="module")
def clauses(spark):
    return spark.createDataFrame([("a", "s", 0, "It rains."), ("b", "s", 1, "Go home!"), ("c", "s", 2, "Odd one.")], "clause_id string, section_id string, idx long, ctext string")


def answers(texts):
    table = {"It rains.": ("Declarative", 0.9, 0.4, "topical"), "Go home!": ("imperitive", 2.0, 0.4, "marked")}
    return [table.get(t) for t in texts]


def test_payloads(spark, clauses):
    got = {r.clause_id: r for r in an.payloads(clauses, an.annotate(clauses, answers)).collect()}
    assert (got["a"].mood, got["a"].modality, got["a"].annotation_source, got["a"].theme_type) == ("declarative", 0.9, "llm", "topical")
    assert (got["b"].mood, got["b"].modality, got["b"].annotation_source) == ("declarative", 0.5, "fallback")
    assert got["c"].annotation_source == "fallback" and got["c"].topical_theme == "Odd"


def test_retry_and_cache(spark, clauses):
    calls = []

    def flaky(texts):
        calls.append(1)
        raise OSError

    assert an.with_retry(flaky)(["x", "y"]) == [None, None] and len(calls) == 3
    from stancelake.operators.catalog import cache_key

    key = cache_key(F.col("section_id"), F.col("idx"), F.col("ctext")).alias("cache_key")
    cache = clauses.where("clause_id = 'c'").select(key, F.lit("minor").alias("mood"), F.lit("llm").alias("annotation_source"))
    rows, add = an.cached(clauses, cache, answers)
    got = {r.clause_id: (r.mood, r.annotation_source) for r in rows.collect()}
    assert got == {"a": ("declarative", "llm"), "b": ("declarative", "fallback"), "c": ("minor", "llm")} and add.count() == 1


def test_trace_is_canonical(spark):
    df = spark.sql("select array(named_struct('type','b','source','x'), named_struct('type','a','source','y')) p, array(named_struct('type','a','source','y'), named_struct('type','b','source','x')) q, map('m','1','k','2') c, map('k','2','m','1') d")
    r = df.select(an.trace(F.col("p"), F.lit("r"), F.col("c")).alias("x"), an.trace(F.col("q"), F.lit("r"), F.col("d")).alias("y")).first()
    assert r.x == r.y


def test_embeddings(spark):
    rows = spark.createDataFrame([("s1", "a", [1.0, 2.0]), ("s1", "b", [1.0]), ("s2", "c", None), ("s2", "d", [float("nan"), 1.0])], "section_id string, clause_id string, embedding array<double>")
    good, bad = an.embeddings(rows, 2)
    assert [r.clause_id for r in good.collect()] == ["a"]
    assert {r.clause_id: r.embedding_error for r in bad.collect()} == {"b": "wrong size", "c": "no vector", "d": "not finite"}
    assert an.redrive(good.unionByName(bad)).count() == 4
    v = spark.createDataFrame([("one two two",)], "t string").select(an.hashed_embedding(F.col("t"), 8).alias("v")).first().v
    assert abs(sum(x * x for x in v) - 1) < 1e-12


def test_digest(spark):
    text = 'Turn 1 by Ann is declarative. Tenor is 0.31 at turn 9. Because of turn 2, it shifted. She said "we will all go home" then. First turn 3, then turn 1. Maybe 40% rose.'
    rows = dg.narrative_sentences(spark.createDataFrame([("n", text)], "id string, text string"))
    turns = spark.createDataFrame([("n", 1, "Ann", "imperative", False), ("n", 2, "Bo", "declarative", True), ("n", 3, "Ann", "declarative", False)], "id string, turn long, speaker string, mood string, shifted boolean")
    numbers = spark.createDataFrame([("n", 0.312, False), ("n", 0.4, False)], "id string, value double, percent boolean")
    previews = spark.createDataFrame([("n", "Yes, we will all go homes now")], "id string, preview string")
    claims = dg.number_claims(rows, numbers).unionByName(dg.turn_claims(rows, turns)).unionByName(dg.connective_claims(rows, turns.where("shifted").select("id", "turn"))).unionByName(dg.quote_claims(rows, previews))
    got = sorted((r.check, r.pos, r.failed) for r in claims.collect())
    assert got == [
        ("causal_connective", 2, False),
        ("number", 1, False),
        ("number", 5, False),
        ("quote", 3, False),
        ("temporal_connective", 4, True),
        ("turn_attribute", 0, False),
        ("turn_attribute", 0, True),
        ("turn_reference", 0, False),
        ("turn_reference", 1, True),
        ("turn_reference", 2, False),
        ("turn_reference", 4, False),
        ("turn_reference", 4, False),
    ]
    p = dg.precision(claims).first()
    assert p.claims == 12 and p.failed == 3 and abs(p.precision - (1 - 3 / (11 + 0.3))) < 1e-9
    s = spark.createDataFrame([("# t\n## A\nx\ny\n## B\nz",)], "t string").select(dg.narrative_sections(F.col("t")).alias("s")).first().s
    assert [(x.heading, x.body) for x in s] == [("A", "x\ny"), ("B", "z")]


def test_parsed_transcripts(spark):
    rows = [("t", 0, "Ann", "Hi\\nthere"), ("t", 1, "", "Yo"), ("u", 0, "Ann", "x\n**Bo**\ny"), ("u", 1, "Bo", "z"), ("v", 0, "A", "a\\nb\nc")]
    good, bad = ex.accepted(ex.check_parsed(spark.createDataFrame(rows, "id string, pos long, name string, mes string")))
    assert [(r.name, r.mes) for r in good.orderBy("pos").collect()] == [("Ann", "Hi\nthere"), ("Unknown Speaker", "Yo")]
    assert {r.id: r.problem for r in bad.collect()} == {"u": "speaker_attribution", "v": "mixed_escape"}


def test_exports(spark, tmp_path):
    from stancelake.sources import loaders as ld

    units = spark.createDataFrame([("c#turn-0", "c", "U", True, "x"), ("c#turn-1", "c", "A", False, "y")], "section_id string, document_key string, speaker string, is_user boolean, text string").withColumn("sent_at", F.lit(None).cast("timestamp"))
    ex.expand(units, str(tmp_path / "out"))
    back = ld.chat_jsonl(ld.text_files(spark, str(tmp_path / "out")).where("path like '%.json'"))
    assert [r.text for r in back.orderBy("section_id").collect()] == ["x", "y"]
    listing = spark.createDataFrame([(json.dumps({"models": [{"name": "m:1", "model": "m:1"}, {"name": "text-embed", "model": "e"}]}),), (json.dumps({"data": [{"id": "h", "context_length": 5, "architecture": {"input_modalities": ["image"]}}]}),)], "content string")
    assert [r.model_id for r in ex.capable(ex.model_rows(listing), "chat").collect()] == ["h", "m:1"]
    report = spark.createDataFrame([("p", json.dumps({"metadata": {"conversation_id": "c"}, "turns": [{"turn_id": 1, "speaker": "A"}]})), ("q", "{}")], "path string, content string")
    assert {(r.path, r.problem, r.turn_id) for r in ex.read_report(report).collect()} == {("p", None, 1), ("q", "no metadata", None)}
    assert ex.resolve_target("git@x.org:a/b") == ("git", "git@x.org:a/b")
    assert ex.resolve_target(str(tmp_path))[0] in ("folder", "worktree")
    with pytest.raises(ValueError):
        ex.resolve_target(str(tmp_path / "none"))
