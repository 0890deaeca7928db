"""Column functions and small-table operators on rows written here."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stancelake import contracts
from stancelake.functions import labels, lexicon, text as tx
from stancelake.operators import catalog, conversation as cv, filters, graph, retrieval, sinks, topics
from stancelake.plans.engine import Engine


def column(spark, values, f, kind="string"):
    return [r.y for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_bands(spark):
    texts = ["It might rain.", "It can't possibly rain.", "He said \"maybe\" and left.", "Of course it is not certain.", "I think so", "It will probably not.", "No doubt.", None, "This is not clearly so"]
    assert column(spark, texts, lexicon.band) == ["low", "high", None, "high", "low", "median", "high", None, "low"]


def test_process(spark):
    rows = [("think", "x", "VB"), ("feel", "x", "VB"), ("look", "x", "VB"), ("say", "x", "VB"), ("exist", "There exist two", "VB"), ("be", "there is", "VB"), ("run", "x", "VB"), ("can", "x", "MD")]
    df = spark.createDataFrame(rows, "l string, t string, g string")
    assert [r.p for r in df.select(lexicon.process(F.col("l"), F.col("t"), F.col("g")).alias("p")).collect()] == ["mental", "mental", "relational", "verbal", "existential", "relational", "material", "mental"]


def test_labels(spark):
    df = spark.createDataFrame([("Declarative",), ("noun_phrase",), ("imperitive",), ("question",), ("qq",), (None,)], "raw string")
    got = {r.raw: (r.raw_label, r.raw_status) for r in labels.normalise(df, "raw").collect()}
    assert got == {"Declarative": ("declarative", "exact"), "noun_phrase": ("fragment", "exact"), "imperitive": ("imperative", "fuzzy"), "question": ("interrogative", "aliased"), "qq": ("declarative", "unknown"), None: ("declarative", "aliased")}
    df = spark.createDataFrame([("topical + textual",), ("theme_marked",), ("textual > topical",), ("topical_unmarked",)], "raw string")
    assert [r.raw_label for r in labels.normalise(df, "raw", "theme_type").orderBy("raw").collect()] == ["multiple", "marked", "topical", "topical"]
    assert labels.jaro_winkler("imperitive", "imperative") >= 0.92 > labels.jaro_winkler("performative", "imperative")
    assert labels.jaro_winkler("", "a") == 0


def test_text(spark):
    assert column(spark, ["A  b—c!", "Ünï 1"], tx.normalise) == ["a b c", "ünï 1"]
    assert column(spark, ["He said “hi”… so"], tx.plain_punctuation) == ['He said "hi"... so']
    assert column(spark, ["x" * 60, "y"], lambda c: tx.preview(c, 50)) == ["x" * 50 + "...", "y"]
    assert column(spark, ["`" + "a" * 90 + "`", "`a` b"], tx.code_heavy) == [True, False]
    assert column(spark, ["and so", "And so", "The end", "x", ""], tx.continues) == [True, True, False, True, False]
    assert column(spark, ["Done.", "not ", None], tx.terminal) == [True, False, False]
    assert column(spark, ["see [a:1] and [b]"], tx.citations) == [["a:1", "b"]]
    r = column(spark, ["The cat sat on the mat."], tx.readability)[0]
    assert r.word_count == 6 and abs(r.flesch - 116.145) < 0.01
    assert column(spark, [""], tx.readability)[0].flesch is None


def test_contracts(spark):
    rows = spark.createDataFrame([Row(mood="declarative", process_type="material", annotation_source="llm", modality=0.5, tenor=1.0), Row(mood="odd", process_type="material", annotation_source="llm", modality=float("nan"), tenor=0.1)])
    good, bad = contracts.quarantine(rows)
    assert good.count() == 1 and bad.first().violations == ["mood", "modality"]


def test_filters(spark):
    with pytest.raises(ValueError):
        filters.condition(colour="red")
    with pytest.raises(ValueError):
        filters.page(spark.range(3), ["id"], 0)
    rows, total = filters.page(spark.range(10), ["id"], 2, 3)
    assert [r.id for r in rows.collect()] == [3, 4] and total == 10


def test_starving_filter(spark):
    """A selective filter before the limit still finds its rows."""
    rows = spark.createDataFrame([(i, "the cat " * (100 - i), "a" if i > 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    assert retrieval.keyword_top(rows.where("source = 'a'"), ["cat"], 3).count() == 3


def test_catalog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "k long, v string")
    got = sorted((r.k, r.v, r.outcome) for r in catalog.upsert(old, new, "k", ["v"]).collect())
    assert got == [(1, "a", "kept"), (2, "B", "updated"), (3, "c", "inserted")]


def test_graph(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "node string, parent string")
    assert sorted((r.node, r.ancestor, r.level) for r in graph.ancestors(e).collect()) == [("b", "a", 1), ("c", "a", 2), ("c", "b", 1), ("d", "a", 1)]
    assert graph.cycles(e).count() == 0
    state = {r.node: r.state for r in graph.selection(e, spark.createDataFrame([("b",)], "node string")).collect()}
    assert state == {"a": "partial", "b": "full", "c": "full", "d": "none"}
    loop = spark.createDataFrame([("x", "y"), ("y", "x")], "node string, parent string")
    assert graph.cycles(loop).count() == 2


def test_long_cycles(spark):
    ring = [(i, (i + 1) % 100) for i in range(100)]
    tail = [(1000 + i, 1000 + i + 1) for i in range(60)] + [(1060, 7)]
    chain = [(2000 + i, 2000 + i + 1) for i in range(60)] + [(2060, None), (5, None)]
    e = spark.createDataFrame(ring + tail + chain + [(3000, 3000)], "node long, parent long")
    want = [*range(100), 3000]
    assert sorted(r.node for r in graph.cycles(e).collect()) == want
    # with a second parent, and a way between two cycles that is on neither
    more = e.union(spark.createDataFrame([(50, 4000), (4000, 3000), (1000, 4000)], "node long, parent long"))
    assert sorted(r.node for r in graph.cycles(more).collect()) == want


def test_topics(spark):
    df = spark.sql("select map('a', 1.0d) x, map('b', 1.0d) y, map('a', 2.0d) z, map() w")
    got = df.select(topics.map_cosine_distance(F.col("x"), F.col("y")).alias("o"), topics.map_cosine_distance(F.col("x"), F.col("z")).alias("s")).first()
    assert (got.o, got.s) == (1.0, 0.0)
    assert topics.clamp_k(10, 9) == 3 and topics.clamp_k(0, 9) is None and topics.clamp_k(5, 1) == 2


def test_lda_vocabulary(spark):
    """Three uses make a word, in one text too; the two most frequent words go; small shares are zero."""
    rows = [(1, "common often " * 9 + "river river river boat"), (2, "common often " * 8 + "castle castle castle"), (3, "common often " * 7 + "river castle " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = topics.vocabulary(docs.select(F.split(F.trim("text"), " ").alias("w")), "w")
    assert words == ["castle", "river"]  # 23 times each; common and often 24 times; boat once
    assert topics.vocabulary(docs.select(F.split(F.trim("text"), " ").alias("w")), "w", least=1, top=0)[-1] == "boat"
    many = spark.range(20_500).select(F.expr("flatten(array_repeat(array('w' || id), 3))").alias("w"))
    assert len(topics.vocabulary(many, "w")) == 20_498
    more = rows + [(10 + i, f"{w} boat sail harbour mast anchor " * 30) for i, w in enumerate(["river", "castle"] * 4)]
    shares, _ = topics.fit_lda(spark.createDataFrame(more, "doc_id long, text string"), 2)
    got = [x for r in shares.collect() for x in r.shares]
    assert len(got) == 22 and all(x == 0 or x > 0.01 for x in got) and 0 in got


def test_profiles_without_trusted(spark):
    t = spark.createDataFrame([("a", 0, "x", 1, 0, 0.5, 0.5)], "conv_id string, turn long, speaker string, n_clauses long, n_trusted long, avg_tenor double, avg_modality double")
    r = cv.speaker_profiles(t).first()
    assert r.avg_tenor is None and r.tenor_variance is None and r.turn_count == 1


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    u = spark.createDataFrame([("s#1", "It might rain. He must go!")], "section_id string, text string")
    c = e.compile(u)
    assert {r.annotation_source for r in c.collect()} == {"lexicon"}
    e.store(c)
    e.store(e.compile(spark.createDataFrame([("s#1", "Now one."), ("s#2", "Two.")], "section_id string, text string")))
    assert e.read("clauses").count() == 2


def test_sinks(spark, data):
    from stancelake.plans import queries as q

    t = q.turn_rows(spark, data)
    units = q.read(spark, data, "conversations")
    rows = sinks.turn_report(t, units)
    assert rows.count() == t.count()
    assert all(len(r.message_preview) <= 53 for r in rows.collect())
    c = q.clause_rows(spark, data)
    files = sinks.annotated_documents(c, "section_id")
    assert files.count() == c.select("section_id").distinct().count() == files.select("file_name").distinct().count()
    sections = c.select("section_id").distinct().withColumns({"collection": F.lit("x"), "document_key": F.lit("d"), "section_path": F.col("section_id"), "document_position": F.lit(1), "ordinal": F.lit(1)})
    assert sinks.export_jsonl(c, sections.unionByName(sections)).count() == c.count()
    assert "## Speakers" in Engine(spark, "/tmp/none").report(c)


def test_stems(spark):
    from stancelake.functions.stem import stem, stems

    pairs = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
    hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit
    operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal triplicate triplic formative form formalize formal electrical electr goodness good revival reviv
    allowance allow inference infer adjustable adjust replacement replac adoption adopt communism commun activate activ probate probat rate rate cease ceas controll control roll roll a a""".split()
    assert [stem(w) for w in pairs[::2]] == pairs[1::2]
    df = spark.createDataFrame([(["cats", "running"],), (None,)], "w array<string>")
    assert [r.s for r in df.select(stems(F.col("w")).alias("s")).collect()] == [["cat", "run"], None]


def test_words_are_cut_once_a_clause(spark):
    df = spark.createDataFrame([("it is not perhaps so",), ("said he",), (None,)], "t string")
    for column, want in ((lexicon.band(F.col("t")), ["high", None, None]), (lexicon.process_of_text(F.col("t")), ["relational", "verbal", "material"])):
        out = df.select("t", column.alias("x"))
        assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
        assert [r.x for r in out.collect()] == want
