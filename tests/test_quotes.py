"""Quotes in whole texts: the letter bound drops no run that is alike."""

import random

from stancelake.functions.labels import jaro_winkler
from stancelake.operators import digest


def brute(quote, text):
    words, width = text.split(), len(quote.split())
    return any(jaro_winkler(quote, " ".join(words[i : i + width])) >= digest.LIKE for i in range(max(len(words) - width, 0) + 1)) if words else False


def test_bound_drops_nothing():
    r = random.Random(1)
    found = 0
    for _ in range(1500):
        text = " ".join("".join(r.choice("abcdéf") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 15)))
        words, n = text.split(), r.randint(1, 6)
        at = r.randrange(len(words))
        quote = list(" ".join(words[at : at + n]))
        for _ in range(r.randint(0, len(quote) // 3 + 1)):
            quote[r.randrange(len(quote))] = r.choice("abcdéf")
        quote = "".join(quote)
        assert digest.alike(quote, text) == brute(quote, text)
        found += digest.alike(quote, text)
    assert 300 < found < 1400
    assert not digest.alike("x", "") and not digest.alike("", "x") and digest.alike("ab cd", "ab") == brute("ab cd", "ab")


def test_deep_quotes_are_found(spark):
    filler = "nothing of the kind stands here at all " * 300
    texts = spark.createDataFrame([(1, filler + "the quick brown fox jumps over it " + filler), (2, filler), (3, None)], "id int, text string")
    quotes = spark.createDataFrame([(i, q) for i in (1, 2, 3) for q in ("quick brown fox jumps", "quik brown fox jumqs")], "id int, quote string")
    got = sorted((r.id, r.quote, bool(r.found)) for r in digest.found_in(quotes, texts, ["id"]).collect())
    assert [x[2] for x in got] == [True, True, False, False, False, False]


def test_halves_of_swaps_are_whole():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dwayne", "duane"), 4) == 0.84 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133


def test_letters_beyond_ascii_are_as_many_places_as_bytes():
    import duckdb

    r = random.Random(2)
    told = lambda: "".join(r.choice("abcdéüß ") for _ in range(r.randint(1, 40)))
    pairs = [(a, a[: r.randint(0, len(a))] + told()[:6]) for a in (told() for _ in range(500))]
    for a, b in [*pairs, ("é", "è")]:
        want = duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert (jaro_winkler(a, b) >= digest.LIKE) == (want >= digest.LIKE)
    assert jaro_winkler("é", "è") > 0.6


def test_four_checks_read_written_turns_and_sentences(spark, data, monkeypatch):
    from stancelake.plans import queries

    made = []
    settle = queries.settle
    monkeypatch.setattr(queries, "settle", lambda df, name: (made.append(name), settle(df, name))[1])
    queries.narrative_checks(spark, data)
    assert sorted(made) == ["narrative-sentences", "narrative-turns"]
