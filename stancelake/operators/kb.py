"""Knowledge-base assessment: type, quality, bucket, action. Ages are measured against an explicit as_of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights and thresholds.
SOURCE_MILLI = {"llm": 1000, "human": 1000, "fallback": 400, "stub": 100, "chunk_artifact": 150}
OTHER_MILLI = 300
CEILING, STALE_MONTHS = 20, 18
KEEP, UPDATE, ARCHIVE = 650, 500, 350
HIGH, MEDIUM = 650, 400
TAGS = {
    "draft": ("draft", "wip", "work-in-progress", "in-progress"),
    "tutorial": ("tutorial", "how-to", "guide", "step-by-step", "walkthrough"),
    "technical_reference": ("reference", "api", "documentation", "spec", "specification"),
    "research_note": ("research", "analysis", "study", "notes", "literature-review"),
}


def source_weight(source: Column) -> Column:
    out = F.lit(OTHER_MILLI)
    for s, w in SOURCE_MILLI.items():
        out = F.when(source == s, w).otherwise(out)
    return out.cast("long")


def months_old(updated: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / F.lit(2_592_000_000_000.0)


def freshness(updated: Column, as_of: Column) -> Column:
    """1 when new, 0 at 18 months of 30 days; 0.5 for an unknown age."""
    return F.when(updated.isNull(), 0.5).otherwise(F.greatest(1.0 - months_old(updated, as_of) / STALE_MONTHS, F.lit(0.0)))


def quality_milli(source_sum: Column, modality_sum: Column, n: Column, fresh: Column) -> Column:
    """.40 source, .30 modality, .20 substance, .10 freshness, in thousandths; 0 without clauses."""
    raw = 0.4 * (source_sum / n) + 0.3 * (modality_sum / n) + 200.0 * F.least(n / F.lit(float(CEILING)), F.lit(1.0)) + 100.0 * fresh
    return F.when(n > 0, F.least(F.greatest(F.floor(raw + 0.5), F.lit(0)), F.lit(1000))).otherwise(F.lit(0)).cast("long")


def artifacts(clauses: DataFrame, by: str) -> DataFrame:
    """Sums of each artifact's clauses: count, weights of sources, modality, sources by kind."""
    src = F.col("annotation_source")
    return clauses.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(source_weight(src)).alias("source_sum"),
        F.sum("modality_milli").alias("modality_sum"),
        F.count_if(src == "llm").alias("llm"),
        F.count_if(src == "human").alias("human"),
        F.count_if(~src.isin("llm", "human")).alias("fallback"),
    )


def profiled(clauses: DataFrame, by: str) -> DataFrame:
    """artifacts(clauses, by) with the dominant mood and process of each (ties: the first seen).

    One pass over the clauses: what comes after works on their counts by mood and process.
    """
    src = F.col("annotation_source")
    sums = {"n": F.count("*"), "source_sum": F.sum(source_weight(src)), "modality_sum": F.sum("modality_milli"), "llm": F.count_if(src == "llm"), "human": F.count_if(src == "human"), "fallback": F.count_if(~src.isin("llm", "human"))}
    cells = clauses.groupBy(by, "mood", "process_type").agg(*[c.alias(k) for k, c in sums.items()], F.min("idx").alias("at"))
    cells = cells.groupBy(by).agg(*[F.sum(k).alias(k) for k in sums], F.collect_list(F.struct("mood", "process_type", "n", "at")).alias("cells"))  # at most moods times processes of them

    def top(field: str) -> Column:
        names = F.array_distinct(F.transform("cells", lambda c: c[field]))

        def total(m: Column) -> Column:
            own = F.filter("cells", lambda c: c[field] == m)
            n = F.aggregate(own, F.lit(0).cast("long"), lambda a, c: a + c["n"])
            return F.struct(n.alias("n"), (-F.array_min(F.transform(own, lambda c: c["at"]))).alias("at"), m.alias("m"))

        return F.array_max(F.transform(names, total))["m"]

    return cells.select(by, *sums, top("mood").alias("dominant_mood"), top("process_type").alias("dominant_process_type"))


def content_type(text: Column, n: Column, modality_mean: Column, mood: Column, process: Column, tags: Column | None = None, kind: Column | None = None) -> Column:
    """One ordered cascade: image, disclaimer, tags, code, stub, stance, else a research note."""
    from stancelake.functions.text import code_heavy

    out = F.when(kind == "image", "image") if kind is not None else F.when(F.lit(False), "image")
    out = out.when(F.lower(text).rlike(r"ai responses?\s+may\s+include\s+mistakes"), "ai_generated")
    if tags is not None:
        for name, patterns in TAGS.items():
            out = out.when(F.exists(tags, _tagged(patterns)), name)
    out = out.when(code_heavy(text), "code_snippet").when((n <= 2) & (F.length(text) < 250), "index")
    out = out.when((n > 0) & (modality_mean > 0.7) & (mood == "declarative"), "technical_reference")
    return out.when((n > 0) & (process == "material") & (mood == "imperative"), "tutorial").otherwise("research_note")


def _tagged(patterns: tuple[str, ...]):
    return lambda t: F.lower(t).rlike("|".join(patterns))


def action(kind: Column, quality: Column) -> Column:
    """What to do with an artifact of this type and quality (thousandths)."""
    out = F.when(kind.isin("ai_generated", "draft", "code_snippet", "image"), "review").when(quality < ARCHIVE, "archive")
    out = out.when(kind.isin("technical_reference", "tutorial") & (quality >= KEEP), "keep")
    return out.when(quality >= UPDATE, "update").otherwise("archive")


def bucket(quality: Column) -> Column:
    return F.when(quality >= HIGH, "high").when(quality >= MEDIUM, "medium").otherwise("low")


def stale(updated: Column, as_of: Column) -> Column:
    """Older than 18 months of 30 days; an unknown age isn't."""
    return F.coalesce(months_old(updated, as_of) > STALE_MONTHS, F.lit(False))


def queue_reason(source: Column, quality: Column, media: Column) -> Column:
    return F.when(media == "image", "image").when(media == "audio", "audio_transcript").when(~source.isin("llm", "human"), "fallback_annotation").when(quality < MEDIUM, "low_quality_score")


def top_per_type(rows: DataFrame, k: int = 5) -> DataFrame:
    """The first k artifacts of each type by quality, ties by id."""
    w = Window.partitionBy("content_type").orderBy(F.desc("quality_milli"), "artifact_id")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
