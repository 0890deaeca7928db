"""Text functions: normalising, cutting, extracting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that is written plainly, and words too common to show that two texts agree.
PUNCTUATION = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u02bc": "'", "\u2032": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2033": '"',
    "\u2013": " - ", "\u2014": " - ", "\u2015": " - ", "\u2212": " - ", "\u2026": "...", "\u00a0": " ", "\u2007": " ", "\u202f": " ", "\u200b": "",
}
STOP_WORDS = """the and but for are was were has have had that this with from into about over also not can all its they their them there what
when where who which how any more one two does did will would could should been being just then such each only than those these very well""".split()


def plain_punctuation(text: Column) -> Column:
    for a, b in PUNCTUATION.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalise(text: Column) -> Column:
    """Lower case, letters and digits alone, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def preview(text: Column, n: int = 50) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def content_words(text: Column, least: int = 3) -> Column:
    """Distinct ASCII words of three letters or more that aren't stop words, in order."""
    found = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= least)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def sentences(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![^.!?\n])[^.!?\n]++[.!?]++"), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def code_characters(text: Column) -> Column:
    """Characters inside backticks."""
    spans = F.regexp_extract_all(text, F.lit(r"`[^`\n]+`|```[\s\S]*?```"), F.lit(0))
    return F.aggregate(spans, F.lit(0), lambda a, s: a + F.length(s))


def code_heavy(text: Column) -> Column:
    n = code_characters(text)
    return (n >= 80) & (n / F.greatest(F.length(text), F.lit(1)) > 0.25)


def terminal(text: Column) -> Column:
    return F.coalesce(F.right(F.rtrim(text), F.lit(1)).isin(".", "!", "?", '"'), F.lit(False))


# Words that go on with a sentence.
CONTINUATIONS = ("and", "but", "or", "because", "although", "though", "since", "unless", "while", "which", "that", "where", "when")


def continues(text: Column) -> Column:
    """Begins in lower case or with a word that goes on with a sentence."""
    first = F.regexp_extract(F.ltrim(text), "^[A-Za-z']+", 0)
    letter = F.substring(first, 1, 1)
    return (first != "") & (((letter == F.lower(letter)) & (letter != F.upper(letter))) | F.lower(first).isin(*CONTINUATIONS))


def strip_markdown(text: Column) -> Column:
    """Front matter, fenced code, tags, entities and marks go; paragraphs stay, a blank line between."""
    out = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", "")
    out = F.regexp_replace(out, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"`([^`\n]*)`", "$1")
    out = F.regexp_replace(out, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"https?://\S+", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"&[a-z#0-9]+;", " ")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(?:#{1,6}|[-*+]|>|\d+\.)\s+", "")
    out = F.regexp_replace(out, r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1")
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.array_join(lines, "\n\n")


def syllables(word: Column) -> Column:
    """Groups of vowels, a final e aside; one at least. A heuristic of our own."""
    return F.greatest(F.size(F.regexp_extract_all(F.regexp_replace(F.lower(word), "e$", ""), F.lit("[aeiouy]+"), F.lit(0))), F.lit(1))


def readability(text: Column) -> Column:
    """flesch, kincaid, fog (published formulas; null without words) and word_count."""
    found = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))
    n = F.size(found).cast("double")
    cut = F.greatest(F.size(F.regexp_extract_all(text, F.lit("[.!?]+"), F.lit(0))), F.lit(1)).cast("double")
    beats = F.aggregate(found, F.lit(0), lambda a, w: a + syllables(w)).cast("double")
    hard = F.size(F.filter(found, lambda w: syllables(w) >= 3)).cast("double")
    some = n > 0
    return F.struct(
        F.when(some, 206.835 - 1.015 * F.try_divide(n, cut) - 84.6 * F.try_divide(beats, n)).alias("flesch"),
        F.when(some, 0.39 * F.try_divide(n, cut) + 11.8 * F.try_divide(beats, n) - 15.59).alias("kincaid"),
        F.when(some, 0.4 * (F.try_divide(n, cut) + 100 * F.try_divide(hard, n))).alias("fog"),
        F.size(found).alias("word_count"),
    )
