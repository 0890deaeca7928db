"""Claims of a narrative about a conversation, checked against its digest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.functions import lexicon
from stancelake.functions.labels import jaro_winkler
from stancelake.functions.text import normalise
from stancelake.operators.grounding import claim_weight

# Patterns of turns, numbers, quotes, connectives, shifts and negation, and the limits of a match.
TURN = r"(?i)\bturns?\s+(\d+)(?:\s*(?:–|-|to|through|and)\s*(\d+))?"
NUMBER = r"(?<![\w.-])\d+(?:\.\d+)?%?(?!\w)"
QUOTE = "\"([^\"]+)\"|“([^”]+)”"
CAUSAL, TEMPORAL = r"(?i)\b(?:because|therefore|so|as a result)\b", r"(?i)\b(?:first|then|after that|afterwards)\b"
SHIFT, NEGATION = r"(?i)\bshifts?\b", r"(?i)\b(?:no|not|without|never)\b|n't\b"
PERCENT, FRACTION, LEAST_QUOTE, LIKE = 0.5, 0.005, 4, 0.85


def narrative_sentences(narratives: DataFrame) -> DataFrame:
    """(id, pos, sentence, weight): sentences end at . ! or ? before white space; hedged ones weigh less."""
    cut = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = narratives.select("id", F.posexplode(cut).alias("pos", "sentence"))
    return rows.withColumn("weight", claim_weight(lexicon.band(F.col("sentence"))))


def number_claims(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Numbers of sentences (quotes and turn references aside) against numbers(id, value, percent).

    Percentages agree within half a point, fractions within 0.005, whole
    numbers exactly; a digest's percentage also stands as a fraction.
    """
    bare = F.regexp_replace(F.regexp_replace("sentence", QUOTE, " "), TURN, " ")
    c = rows.select("id", "pos", "weight", F.explode(F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0))).alias("literal"))
    j = c.join(numbers, "id", "left")
    x = F.regexp_replace("literal", "%", "").cast("double")
    as_percent = F.when(F.col("percent"), F.col("value")).otherwise(F.col("value") * 100)
    near = F.abs(F.col("value") - x) <= FRACTION
    also = F.col("percent") & (F.abs(F.col("value") / 100 - x) <= FRACTION)
    hit = F.when(F.col("literal").endswith("%"), F.abs(as_percent - x) <= PERCENT).when(F.col("literal").contains("."), near | also).otherwise(F.col("value") == x)
    g = j.groupBy("id", "pos", "literal", "weight").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("ok"))
    return g.select("id", "pos", F.lit("number").alias("check"), "weight", (~F.col("ok")).alias("failed"))


def references(rows: DataFrame) -> DataFrame:
    """(id, pos, at, first, last): turn references of sentences, in order."""
    first = F.regexp_extract_all("sentence", F.lit(TURN), F.lit(1))
    last = F.regexp_extract_all("sentence", F.lit(TURN), F.lit(2))
    z = rows.select("id", "pos", "sentence", "weight", F.posexplode(F.arrays_zip(first.alias("f"), last.alias("l"))).alias("at", "z"))
    return z.select("id", "pos", "sentence", "weight", "at", F.col("z.f").cast("long").alias("first"), F.when(F.col("z.l") == "", F.col("z.f")).otherwise(F.col("z.l")).cast("long").alias("last"))


def turn_claims(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """References against turns(id, turn, speaker, mood, shifted): they exist; a single one's speaker, mood and shift agree."""
    r = references(rows)
    each = r.withColumn("turn", F.explode(F.when(F.col("first") <= F.col("last"), F.sequence("first", "last")).otherwise(F.array().cast("array<long>"))))
    j = each.join(turns, ["id", "turn"], "left")
    exist = j.groupBy("id", "pos", "at", "weight").agg(F.bool_or(F.col("speaker").isNull()).alias("failed"))
    out = exist.select("id", "pos", F.lit("turn_reference").alias("check"), "weight", "failed")
    one = j.where("first = last and speaker is not null")
    names = turns.groupBy("id").agg(F.collect_set("speaker").alias("names"))
    one = one.join(names, "id").withColumn("said", F.filter("names", lambda n: F.col("sentence").contains(n)))
    speaker = one.where(F.size("said") > 0).select("id", "pos", F.lit("turn_attribute").alias("check"), "weight", (~F.array_contains("said", F.col("speaker"))).alias("failed"))
    moods = F.array(*[F.when(F.col("sentence").rlike(rf"(?i)\b{m}\b"), F.lit(m)) for m in ("declarative", "interrogative", "imperative", "exclamative")])
    named = one.withColumn("moods", F.filter(moods, lambda m: m.isNotNull())).where(F.size("moods") > 0)
    mood = named.select("id", "pos", F.lit("turn_attribute").alias("check"), "weight", (~F.array_contains("moods", F.col("mood"))).alias("failed"))
    moved = one.where(F.col("sentence").rlike(SHIFT) & ~F.col("sentence").rlike(NEGATION))
    shift = moved.select("id", "pos", F.lit("turn_attribute").alias("check"), "weight", (~F.col("shifted")).alias("failed"))
    return out.unionByName(speaker).unionByName(mood).unionByName(shift)


def connective_claims(rows: DataFrame, moments: DataFrame, reach: int = 1) -> DataFrame:
    """Causal sentences need a moment(id, turn) near a turn they cite; temporal ones cite turns in order."""
    r = references(rows)
    causal = r.where(F.col("sentence").rlike(CAUSAL))
    near = causal.select("id", "pos", "weight", F.explode(F.sequence(F.col("first") - reach, F.greatest("first", "last") + reach)).alias("turn"))
    m = moments.select("id", "turn").distinct().withColumn("hit", F.lit(True))
    cause = near.join(m, ["id", "turn"], "left").groupBy("id", "pos", "weight").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("ok"))
    cause = cause.select("id", "pos", F.lit("causal_connective").alias("check"), "weight", (~F.col("ok")).alias("failed"))
    order = r.where(F.col("sentence").rlike(TEMPORAL)).groupBy("id", "pos", "weight").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "first"))), lambda s: s["first"]).alias("o"))
    order = order.where("n >= 2").select("id", "pos", F.lit("temporal_connective").alias("check"), "weight", (F.array_sort("o") != F.col("o")).alias("failed"))
    return cause.unionByName(order)


def alike(quote: str, text: str, like: float = LIKE) -> bool:
    """Whether some run of as many words as the quote has is like it, by Jaro-Winkler similarity.

    A run shares no more bytes of UTF-8 with the quote than both hold, wherever
    they stand; only runs that could reach `like` with all of those in order,
    and with the first bytes that they share, are compared byte by byte.
    """
    words, sought = text.encode().split(), quote.encode()
    width = len(sought.split())
    if not words or not sought:
        return False
    told = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width, 0) + 1
    a, b = starts[:n], ends[np.minimum(np.arange(n) + width - 1, len(words) - 1)]
    letters, own = (np.frombuffer(x, dtype=np.uint8) for x in (told, sought))
    shared = np.zeros(n, dtype=np.int64)
    for c, times in zip(*np.unique(own, return_counts=True), strict=True):
        at = np.concatenate([[0], np.cumsum(letters == c)])
        shared += np.minimum(at[b] - at[a], times)
    first, same = np.ones(n, dtype=bool), np.zeros(n)
    for k in range(min(4, len(own))):
        first &= (a + k < b) & (letters[np.minimum(a + k, len(letters) - 1)] == own[k])
        same += first
    jaro = np.where(shared > 0, (shared / len(own) + shared / np.maximum(b - a, 1) + 1) / 3, 0)
    best = jaro + 0.1 * same * (1 - jaro)
    may = np.flatnonzero(best >= like - 1e-9)
    return any(jaro_winkler(sought, told[a[i] : b[i]]) >= like for i in may[np.argsort(-best[may], kind="stable")])


def _similar(quotes: pd.Series, previews: pd.Series) -> pd.Series:
    return pd.Series([q is not None and p is not None and alike(q, p) for q, p in zip(quotes, previews, strict=True)], dtype=bool)


def found_in(quotes: DataFrame, texts: DataFrame, by: list[str]) -> DataFrame:
    """quotes(by, quote) joined to the normalised texts(by, text) of their group, with `found`: contained, or alike somewhere in it."""
    j = quotes.join(texts, by)
    inside = F.col("text").contains(F.col("quote"))
    return j.withColumn("found", F.when(inside, True).otherwise(F.pandas_udf(_similar, "boolean")("quote", "text")))


def quote_claims(rows: DataFrame, previews: DataFrame) -> DataFrame:
    """Quotes of four words or more against previews(id, preview): contained, or alike in a window of as many words."""
    found = F.concat(F.regexp_extract_all("sentence", F.lit(QUOTE), F.lit(1)), F.regexp_extract_all("sentence", F.lit(QUOTE), F.lit(2)))
    q = rows.select("id", "pos", "weight", F.explode(F.filter(found, lambda x: x != "")).alias("quote")).withColumn("quote", normalise(F.col("quote")))
    q = q.where(F.size(F.split("quote", " ")) >= LEAST_QUOTE)
    j = q.join(previews.select("id", normalise(F.col("preview")).alias("preview")), "id", "left")
    inside = F.coalesce(F.col("preview").contains(F.col("quote")), F.lit(False))
    hit = F.when(inside, True).when(F.col("preview").isNull(), False).otherwise(F.pandas_udf(_similar, "boolean")("quote", "preview"))
    g = j.groupBy("id", "pos", "weight", "quote").agg(F.bool_or(hit).alias("ok"))
    return g.select("id", "pos", F.lit("quote").alias("check"), "weight", (~F.col("ok")).alias("failed"))


def precision(claims: DataFrame) -> DataFrame:
    """By narrative: claims, failed ones, and 1 less the weight that failed over all."""
    total, bad = F.sum("weight"), F.sum(F.when(F.col("failed"), F.col("weight")).otherwise(0.0))
    return claims.groupBy("id").agg(F.count("*").alias("claims"), F.count_if("failed").alias("failed"), (1.0 - F.try_divide(bad, total)).alias("precision"), F.count_if((F.col("check") == "causal_connective") & F.col("failed")).alias("fabricated_causation"))


def narrative_sections(text: Column) -> Column:
    """Heading and body of each part that begins with a second-level heading."""
    parts = F.filter(F.split(text, r"(?m)^(?=##\s)"), lambda p: p.startswith("##"))
    return F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, r"\A##\s+([^\n]*)", 1)).alias("heading"), F.regexp_replace(F.regexp_replace(p, r"\A##[^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body")))


def evidence_line(place: Column, text: Column, mood: Column, tenor: Column, modality: Column, process: Column, section: Column) -> Column:
    return F.format_string("[%d] %s\n    (mood=%s, tenor=%s, modality=%s, process=%s; source: %s)", place, text, mood, tenor.cast("string"), modality.cast("string"), process, section)


def quality_note(excluded: Column, total: Column) -> Column:
    """A note on what was left out; null if nothing was."""
    return F.when(excluded > 0, F.format_string("_Data Quality: %d/%d retrieved clauses excluded due to fallback annotation._", excluded, total))
