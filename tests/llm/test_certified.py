"""Columns named like internal ones, loops that must not end in silence, redaction and fits held against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stancelake.llm import crf_quality, html_density, mixing, near_copies, pii

CLASHES = ["_id", "_node", "node", "first_id", "component", "_copies_id", "_copies_node", "__pii_marks", "__pii_key", "__pii_id", "__pii_text", "mark_key", "mark_id", "marks", "whole", "own_id", "own_key", "kept_key", "kept_id", "copies", "copy", "__mix_n", "__mix_key", "__mix_id", "row_key", "rate", "n_tokens", "_c0", "_c1", "_c2", "_x", "_h"]


def clashing(spark, rows):
    """(doc_id, text) rows with a column of every internal name beside them, some in front."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select(*[F.lit(f"own {c}").alias(c) for c in CLASHES[:16]], "doc_id", "text", *[F.lit(f"own {c}").alias(c) for c in CLASHES[16:]])


def intact(out, docs):
    assert out.columns == docs.columns
    for row in out.collect():
        assert all(row[c] == f"own {c}" for c in CLASHES)


TEXT = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest at night"


def test_near_dedup_keeps_clashing_columns(spark):
    docs = clashing(spark, [(1, TEXT), (2, TEXT), (3, "another text of quite other words than those"), (None, None), (3, "another text of quite other words than those")])
    out = near_copies.one_of_each(docs)
    intact(out, docs)
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]


def test_redact_keeps_clashing_columns(spark):
    docs = clashing(spark, [(1, "write to a@b.de now"), (None, None), (2, "nothing"), (2, "nothing")])
    out = pii.redact(docs)
    intact(out, docs)
    assert sorted((r["text"] or "") for r in out.collect()) == ["", "nothing", "nothing", "write to [EMAIL] now"]


@pytest.mark.parametrize("most", [1.0, None])
def test_draw_keeps_clashing_columns(spark, most):
    docs = clashing(spark, [(i, f"{TEXT} number {i}") for i in range(40)] + [(None, None)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = mixing.draw(docs, labels, {"clean": 0.5, "junk": 0.5}, most=most)
    intact(out, docs)
    assert out.count() > 0


def plain_replaced(text, marks):
    out, at = [], 0
    for s, e, k in sorted(marks):
        if e > at:
            out.append(text[at : max(s, at)] + k)
            at = e
    return "".join(out) + text[at:]


def test_replaced_equals_plain_code(spark):
    rng, rows = random.Random(5), []
    for i in range(60):
        text = "".join(rng.choice("abcé\U0001f600 ") for _ in range(rng.choice([1, 40, 3000])))
        marks = []
        for _ in range(rng.choice([1, 5, 127, 128, 129, 700])):
            s = rng.randrange(len(text))
            marks.append((s, rng.randint(s + 1, min(len(text), s + rng.choice([1, 4, 600]))), rng.choice(["[A]", "[B]"])))
        rows.append((i, text, sorted(marks)))
    df = spark.createDataFrame(rows, "i long, t string, m array<struct<s:int,e:int,k:string>>")
    got = {r["i"]: r["out"] for r in df.select("i", F.expr(pii._replaced("m", "t")).alias("out")).collect()}
    assert got == {i: plain_replaced(t, m) for i, t, m in rows}


def test_rounds_that_do_not_suffice_are_an_error(spark):
    texts = [f"reach me at name{i}@host.de today please" for i in range(30)] + ["reach me at 48213377 today please"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.spans(docs)
    assert pii.discovered(found, docs.select("text")).count() == 1
    with pytest.raises(RuntimeError):
        pii.discovered(found, docs.select("text"), rounds=1)


def test_rates_off_their_optimum_are_an_error(spark, monkeypatch):
    rows = [(i, i, 10 + i % 7, (i % 10) / 10, 1 - (i % 10) / 10, 0.0) for i in range(200)]
    own = spark.createDataFrame(rows, "doc_id long, row_key long, n_tokens long, p_clean double, p_junk double, p_toxic double")
    want = {d: (0.9, 0.1, 0.0)[i] for i, d in enumerate(("clean", "junk", "toxic"))}
    mixing.rates(own, want)
    monkeypatch.setattr(mixing, "ITERATIONS", 1)
    monkeypatch.setattr(mixing, "LENGTHS", (1e-6,))
    with pytest.raises(RuntimeError):
        mixing.rates(own, want)


def test_fit_in_executors_equals_fit_of_texts(spark):
    rng = random.Random(2)
    good = lambda: "\n".join("This line says something in plain words, as most lines do." if rng.random() < 0.8 else "It ends here." for _ in range(rng.randint(1, 30)))
    bad = lambda: "\n".join("BUY NOW!!! $$$ click click click" if rng.random() < 0.8 else "|| 99 || 88" for _ in range(rng.randint(1, 30)))
    rows = [(i, good() if i % 2 else bad()) for i in range(120)] + [(120, None), (121, "")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = crf_quality.fit_on(docs, labels)
    again = crf_quality.fit_on(docs.repartition(2), labels)
    assert np.array_equal(model.mean, again.mean) and np.array_equal(model.trans, again.trans)
    q = model.quality([good() for _ in range(20)] + [bad() for _ in range(20)])
    assert (q[:20] > 0.7).all() and (q[20:] < 0.5).all()


def test_long_documents_are_thinned_evenly():
    text = "\n".join(f"line {i} of a long document" for i in range(5000))
    x, length = crf_quality.fitted_lines(text)
    assert len(x) == len(length) <= crf_quality.FIT_LINES
    whole, _, n = crf_quality.line_features([text])
    assert np.allclose(x[0], whole[0]) and np.allclose(x[-1], whole[-1], atol=1e-5) and length[-1] == n[-1]
    assert [len(a) for a in crf_quality.fitted_lines("")] == [0, 0]


PAGE = "<html><body>{}</body></html>"
STORY = "<p>The first paragraph of the story has many words, as paragraphs do.</p><p>The second one goes on for a while and then ends.</p>"
WANT = "The first paragraph of the story has many words, as paragraphs do.\n\nThe second one goes on for a while and then ends."


@pytest.mark.parametrize(
    "page",
    [
        f'<form id="aspnetForm"><div>{STORY}</div><input type=hidden value=x><label>Name</label><button>Go</button></form>',
        f'<form action="/"><nav><a href=/>Home</a></nav><article>{STORY}</article></form><form class="search"><p>Search it all</p></form>',
        f"<form><main>{STORY}<form><p>Your view of it</p><textarea>x</textarea></form></main></form>",
        f'<object data="x"><div class="content">{STORY}</div></object>',
        f"<div>{STORY}</div><form><p>Search here</p></form>",
        f"<article hidden><p>What stood here once</p></article><article>{STORY}</article>",
    ],
)
def test_wrappers_around_a_page(page):
    assert html_density.main_text(PAGE.format(page)) == WANT


def test_names_of_inline_elements_in_running_text():
    page = '<p>We said <span class="notice">important words</span> and <em class="social">more</em>. <a class="share" href="/s">Share</a></p>'
    assert html_density.main_text(PAGE.format(page)) == "We said important words and more."
