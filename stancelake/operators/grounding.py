"""Grounding of generated prose: citations, numbers, turn references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.functions.text import citations, content_words, numbers, sentences

SHARED = 2
WEIGHTS = {"high": 1.0, "median": 0.6, "low": 0.3}
PERCENT_TOLERANCE, FRACTION_TOLERANCE = 0.5, 0.005


def sentence_rows(texts: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    return texts.select(id_col, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def check_citations(rows: DataFrame, clauses: DataFrame, id_col: str, clause_id: str = "clause_id", text: str = "text") -> DataFrame:
    """Each sentence (id, pos, sentence) with its verdict.

    A reference names a clause by its id or by section:id. Verdicts: no
    marker, not found, no overlap (under two shared content words), grounded.
    """
    refs = rows.select(id_col, "pos", "sentence", F.explode_outer(citations(F.col("sentence"))).alias("ref"))
    refs = refs.withColumn("tail", F.when(F.col("ref").contains(":"), F.regexp_extract("ref", "^[^:]*:(.*)$", 1)).otherwise(F.col("ref")))
    known = clauses.select(F.col(clause_id).cast("string").alias("tail"), F.col(text).alias("cited"))
    j = refs.join(known, "tail", "left")
    shared = F.size(F.array_intersect(content_words(F.regexp_replace("sentence", r"\[[^\]]*\]", " ")), content_words(F.col("cited"))))
    j = j.withColumns({"missing": F.col("ref").isNotNull() & F.col("cited").isNull(), "weak": F.col("cited").isNotNull() & (shared < SHARED)})
    g = j.groupBy(id_col, "pos").agg(F.count("ref").alias("n_refs"), F.bool_or("missing").alias("any_missing"), F.bool_or("weak").alias("any_weak"))
    verdict = F.when(F.col("n_refs") == 0, "no citation marker").when(F.col("any_missing"), "clause not found").when(F.col("any_weak"), "no keyword overlap").otherwise("grounded")
    return g.select(id_col, "pos", "n_refs", verdict.alias("verdict"))


def citation_coverage(checked: DataFrame, by: str) -> DataFrame:
    """Grounded sentences over all; 0 where there are none."""
    return checked.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "grounded").alias("grounded")).withColumn("coverage", F.coalesce(F.try_divide("grounded", "n"), F.lit(0.0)))


def number_claims(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(id_col, "pos", F.explode(numbers(F.col("sentence"))).alias("literal"))


def grounded_number(claims: DataFrame, facts: DataFrame, id_col: str) -> DataFrame:
    """Claims (id, pos, literal) with whether a fact (id, fact) of the same id matches: fractions within a tolerance, whole numbers exactly."""
    j = claims.join(facts, id_col, "left")
    value = F.col("literal").cast("double")
    near = F.when(F.col("literal").contains("."), F.abs(F.col("fact") - value) <= FRACTION_TOLERANCE).otherwise(F.col("fact") == value)
    return j.groupBy(id_col, "pos", "literal").agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("grounded"))


def weighted_precision(claims: DataFrame) -> DataFrame:
    """From (failed, weight): 1 less the weight that failed over all; 1 without claims."""
    total, bad = F.sum("weight"), F.sum(F.when(F.col("failed"), F.col("weight")).otherwise(0.0))
    return claims.agg(F.coalesce(1.0 - F.try_divide(bad, total), F.lit(1.0)).alias("precision"))


def claim_weight(band: Column) -> Column:
    out = F.lit(1.0)
    for b, w in WEIGHTS.items():
        out = F.when(band == b, w).otherwise(out)
    return out


def causal_support(refs: DataFrame, moments: DataFrame, by: str, reach: int = 1) -> DataFrame:
    """refs (by, turn) with whether a moment (by, turn) stands within `reach` turns: an equi-join over the neighbourhood."""
    near = refs.withColumn("__t", F.explode(F.sequence(F.col("turn") - reach, F.col("turn") + reach)))
    m = moments.select(F.col(by).alias("__by"), F.col("turn").alias("__m")).distinct()
    j = near.join(m, (F.col(by) == F.col("__by")) & (F.col("__t") == F.col("__m")), "left")
    return j.groupBy(by, "turn").agg((F.count("__m") > 0).alias("supported"))
