"""Collocations, against a count in plain Python and, on the tables, against their SQL."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from stancelake.llm import phrases
from stancelake.llm.queries import op13_phrases
from tests.compare import duck_rows, spark_rows

LOW = {c: c + 32 for c in range(65, 91)}


def expected(rows, least=30, longest=4, absorbs=80, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOW)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i : i + m]] = max(inner.get(p[i : i + m], 0), a)
        kept = []
        for p, a in candidates.items():
            if p in inner and 100 * inner[p] >= absorbs * a:
                continue
            score, k = min((int(Fraction(2_000_000 * a, c[p[:k]] + c[p[k:]])), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def some_texts(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "a", "new", "york", "NEW", "Ärger", "été", "x_1", "日本", "-", "that's"]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(words) if r.random() < 0.8 else "in the new york times"
            text += r.choice([" ", " ", " ", "\t ", "  ", ", ", ".", "\n", "\r\n", "; ", "\xa0", "\x0b"])
        texts.append((r.choice([text, text, text, None, ""]), r.choice(["en", "en", "de", None, "und"])))
    return texts


@pytest.mark.parametrize("size", [40, 2000, phrases.SHARD])
def test_equal_plain_counts(spark, size):
    rows = some_texts(1, 400)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert got(phrases.collocations(df, size=size)) == expected(rows)
    assert got(phrases.collocations(df, least=5, longest=3, absorbs=50, top=7, size=size)) == expected(rows, 5, 3, 50, 7)


@pytest.mark.parametrize("spare", [0, 2])
def test_bitmaps_count_every_row_of_words(spare):
    r = np.random.default_rng(spare)
    for length in (0, 1, 7, 8, 9, 64, 500):
        ids = r.integers(-1, 5, length).astype(np.int32)
        found = Counter()
        for p, n in phrases.count(ids, 2, 4, None, min(spare, length)):
            for column, x in zip(p.T.tolist(), n.tolist(), strict=True):
                found[tuple(column)] += x
        want = Counter(tuple(ids[i : i + m].tolist()) for i in range(length - min(spare, length)) for m in (2, 3, 4) if i + m <= length and (ids[i : i + m] >= 0).all())
        assert found == want


def test_long_texts_are_cut_without_losing_phrases(spark):
    r = random.Random(5)
    long = " ".join(r.choice(["ab", "cd", "e"]) for _ in range(3000))  # one piece, longer than any part
    rows = [(long, "en"), ("y" * 500 + " " + "z" * 500, "en"), (long[:700] + "." + long[700:], None)]
    parts = list(phrases.parts(long.encode(), 100))
    assert len(parts) > 50 and all(spare == 3 for _, spare in parts[:-1])
    df = spark.createDataFrame(rows, "text string, lang string")
    assert got(phrases.collocations(df, size=100)) == expected(rows)


def test_repeated_rows_a_hot_language_and_wide_tables(spark):
    rows = [("One and the same line of text.", "en")] * 500 + [("ein und der Satz", "de")] * 31
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "text string, lang string, phrase string, n int")
    assert got(phrases.collocations(df)) == expected(rows)


def test_nothing(spark):
    schema = "text string, lang string"
    assert phrases.collocations(spark.createDataFrame([], schema)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en"), (" .,", "en"), ("a b", "en")], schema)).count() == 0


def test_pair_hash_is_that_of_spark(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(-(2**63), 2**63 - 1, 50), r.integers(-(2**63), 2**63 - 1, 50)
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b, strict=True)], "a long, b long")
    assert [x.h for x in df.selectExpr("xxhash64(a, b) AS h").collect()] == phrases._hash(a, b).tolist()


def test_pairs_that_share_a_hash_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PAIR_BITS", 3)
    rows = some_texts(2, 200)
    assert got(phrases.collocations(spark.createDataFrame(rows, "text string, lang string"))) == expected(rows)


def test_query_equals_sql(spark, data):
    assert spark_rows(op13_phrases(spark, data)) == duck_rows(phrases.SQL, data)
