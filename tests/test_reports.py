"""Reports, stored versions, reviews, retries, walks and stops, on rows written by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stancelake.operators import annotation, catalog, filters, graph, reports, topics
from stancelake.plans import queries as q
from stancelake.plans.engine import Engine
from stancelake.sources import loaders as ld, routing
from stancelake.streaming import runs


def test_decisions(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.store(e.compile(spark.createDataFrame([("s#1", "It might rain. He must go!")], "section_id string, text string")))
    e.decide("s#1:0", "re_annotated", "2024-01-01", annotate=lambda c: c.withColumns({"mood": F.lit("imperative"), "modality": F.lit(0.9), "tenor": F.lit(0.1), "process_type": F.lit("verbal"), "annotation_source": F.lit("human")}))
    e.decide("s#1:1", "accepted", "2024-01-02")
    assert {r.clause_id: r.annotation_source for r in e.read("clauses").collect()} == {"s#1:0": "human", "s#1:1": "lexicon"}
    assert sorted((r.clause_id, r.decision) for r in e.read("reviews").collect()) == [("s#1:0", "re_annotated"), ("s#1:1", "accepted")]
    with pytest.raises(KeyError):
        e.decide("none", "accepted", "2024-01-02")
    with pytest.raises(ValueError):
        catalog.decisions(spark.range(1), "maybe", "2024-01-01")


def test_retries():
    calls, waits = [], []

    def busy(texts):
        calls.append(1)
        raise annotation.Busy(7.0 if len(calls) == 1 else None)

    assert annotation.with_retry(busy, wait=waits.append)(["a", "b"]) == [None, None]
    assert len(calls) == 5 and waits == [7.0, 2.0, 4.0, 8.0]
    calls.clear()

    def broken(texts):
        calls.append(1)
        raise OSError

    assert annotation.with_retry(broken)(["a"]) == [None] and len(calls) == 3
    assert annotation.delay(20) == 30.0


def test_batches_run_on(spark):
    """Batches are filled over Spark's frames, and a single clause gets the same payload."""
    sizes = []

    def call(texts):
        return [(len(texts) - 1 - i, ("imperative", 0.5, 0.25, "unmarked")) for i in range(len(texts))]

    rows = spark.range(0, 95, 1, 1).select(F.col("id").cast("string").alias("clause_id"), F.lit("Go now.").alias("ctext"))
    assert annotation.annotate(rows, call, 40).count() == 95 and not sizes
    one = annotation.annotate_one("Go now.", lambda t: [("imperative", 0.5, 0.25, "unmarked")])
    assert (one["mood"], one["annotation_source"]) == ("imperative", "llm")
    assert annotation.annotate_one("Go now.", lambda t: [None])["annotation_source"] == "fallback"


def test_walk_and_folder(spark, tmp_path):
    for name in ("a.md", "b.tmp.md", "deep/c.md", "deep/d.md", "other/d.md", "e.png", "f.bin", ".g.md", "talk.srt", "empty.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("# Head\nThis sentence is long enough to be kept as a section.\n" if name.endswith("md") else "\n" if name == "empty.txt" else "1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    (tmp_path / ".ignore").write_text("*.tmp.md\n")
    (tmp_path / "deep" / ".ignore").write_text("/d.md\n")
    kept, skipped = routing.walk(spark, str(tmp_path))
    assert sorted(r.relative for r in kept.collect()) == ["a.md", "deep/c.md", "other/d.md"]
    assert {r.reason: r.n for r in skipped.collect()} == {"ignored": 2, "image": 1, "foreign": 3}
    assert [r.relative for r in routing.walk(spark, str(tmp_path / "e.png"))[0].collect()] == ["e.png"]
    units, warnings = Engine(spark, "/none").load_folder(str(tmp_path))
    assert units.where("text like 'This sentence%'").count() == 4 and units.where("text = 'hello'").count() == 1
    assert {r.path.rsplit("/", 1)[1]: r.problem for r in warnings.collect()} == {"empty.txt": "no units", "f.bin": "no loader"}
    files = ld.text_files(spark, str(tmp_path / "empty.txt"))
    with pytest.raises(ValueError, match="empty.txt"):
        ld.required(ld.transcription(files), files)


def test_markdown_report(spark, data):
    c = q.clause_rows(spark, data)
    a = Engine(spark, "/none").analyse(c)
    text = reports.markdown({**a, "traces": c.select("clause_id", F.sha2("ctext", 256).alias("derivation_hash"))}, "all", rows=5, topics=[["a", "b"]])
    for head in ("Data Quality", "Speaker Profiles", "Correlations", "Generated Insights", "Topics", "Key Moments", "Example Passages", "Reasoning Traces"):
        assert f"## {head}" in text
    assert "Heading Profiles" in reports.markdown(a, "d", names=reports.DOCUMENTATION, rows=3)
    t = q.cv.turns(c)
    stance = c.groupBy("conv_id", "process_type").agg(F.count("*").alias("clause_count"), F.count("*").alias("annotated_count"), F.avg("tenor_milli").alias("avg_tenor"))
    r = reports.report_json(t, c, q.cv.key_moments(t), stance, q.cv.insights(t), q.read(spark, data, "conversations"), reports.DOCUMENTATION).first().value
    assert '"document_id"' in r and '"section_count"' in r and '"heading_profiles"' in r
    assert "# Knowledge base" in reports.kb_markdown(q.assessed(spark, data))


def test_narratives():
    text = "intro\n" + "\n".join(f"## {s}\nbody of {s}" for s in reports.NARRATIVE)
    parts = reports.narrative_parts(text)
    assert parts["Takeaways"] == "body of Takeaways"
    with pytest.raises(ValueError, match="Key shifts"):
        reports.narrative_parts(text.replace("body of Key shifts", ""))
    md = reports.narrative_markdown("x", parts, [("number", 1.0, True, "Nine."), ("quote", 3.0, False, "So.")])
    assert "precision: 75.0% (2 claims checked, 1 flagged)" in md and '"Nine."' in md


def test_parameters_and_states(spark):
    assert filters.parameters({"limit": "0", "offset": "-3", "mood": " ", "min_tenor": "0.5"}) == {"limit": 1, "offset": 0, "mood": None, "min_tenor": 0.5}
    with pytest.raises(ValueError):
        filters.parameters({"id": "1"})
    df = spark.sql("select timestamp'2024-01-01 00:00:00' h, timestamp'2024-01-01 00:01:00' n")
    state = lambda alive: df.select(filters.run_state(F.lit("running"), F.col("h"), F.col("n"), 30, alive).alias("s")).first().s
    assert state(F.lit(False)) == "dead" and state(F.lit(True)) == state(None) == "stalled"
    assert filters.projected(df, ("n", "score")).columns == ["n", "score"]


def test_graph_closures(spark):
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(100, 0)]
    up = graph.ancestors(spark.createDataFrame(ring, "node long, parent long"))
    got = {(r.node, r.ancestor): r.level for r in up.collect()}
    assert len(got) == 41 * 40 and got[0, 39] == 39 and got[0, 0] == 40 and got[100, 0] == 1
    two = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], "node long, parent long")
    assert sorted((r.ancestor, r.level) for r in graph.ancestors(two, spark.createDataFrame([(1,)], "node long")).collect()) == [(2, 1), (3, 1), (4, 2), (5, 3)]
    assert graph.ancestors(two.limit(0)).count() == 0


def test_polls_and_topics(spark):
    shown = []
    runs.poll(lambda: spark.createDataFrame([(i, i) for i in range(60)], "run_id long, started_at long"), shown.append, times=2, sleep=lambda s: None)
    assert [len(x) for x in shown] == [50, 50] and shown[0][0].run_id == 59
    assert runs.progress_line(3, 9) == "progress turn=3 total=9"
    d = spark.sql("select 'a' c, map('x', 0.5d, 'y', 0.5d) distribution union all select 'a', map('x', 1.0d) union all select 'a', map()")
    assert {r.topic: r["mean"] for r in topics.baseline(d, "c").collect()} == {"x": 0.75, "y": 0.25}
    assert spark.sql("select array(0.5d, 0.01d, 0.49d) s").select(topics.assigned(F.col("s")).alias("m")).first().m == {0: 0.5, 2: 0.49}


def test_claude_memories(spark, tmp_path):
    p = tmp_path / "memories.json"
    p.write_text('[{"account_uuid": "u", "conversations_memory": "Likes tea.", "project_memories": {"p1": "A plan.", "p2": " "}}]')
    assert sorted((r.heading, r.text) for r in ld.claude_memories(ld.text_files(spark, str(p))).collect()) == [("conversations", "Likes tea."), ("p1", "A plan.")]


def test_the_assessment_is_worked_out_once(spark, tmp_path):
    def note(frames):
        for pdf in frames:
            for i in pdf["artifact_id"]:
                (tmp_path / f"{i}-{random.random()}").write_text("")
            yield pdf

    plain = spark.range(6).selectExpr("id AS artifact_id", "'t' AS title", "'f' AS source_file", "IF(id < 2, 'index', 'draft') AS content_type", "id * 100 AS quality_milli", "'review' AS action", "array('a') AS tags", "TIMESTAMP '2024-01-01 00:00:00' AS last_updated", "'low' AS bucket", "id = 3 AS is_stale")
    head, lines = reports.kb_json(plain.mapInPandas(note, plain.schema))
    told = json.loads(head.first().value)
    assert told["content_type_distribution"] == {"draft": 4, "index": 2} and told["staleness_flags"] == 1 and lines.count() == 6
    assert len(list(tmp_path.iterdir())) == 6
