"""Turn aggregates, shifts, profiles and timelines over annotated clauses.

Clauses come as conv_id, turn, role, idx, tenor_milli, modality_milli, mood,
process_type, annotation_source. Sums stay integers and are divided once, so
results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake.contracts import trusted

TENOR_SHIFT, MODALITY_SHIFT, COHERENCE = 0.15, 0.3, 0.35


def mean3(total_milli: Column, n: Column) -> Column:
    """A mean of thousandths, rounded half up to three places."""
    return F.floor(total_milli.cast("double") / n + 0.5) / 1000.0


def first_seen_top(df: DataFrame, by: list[str], value: str, position: Column) -> DataFrame:
    """The most frequent value of each group, ties to the one seen first."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("at"))).alias(f"dominant_{value}"))


def turns(clauses: DataFrame) -> DataFrame:
    """One row a turn that has clauses: means, dominant mood, process tally."""
    key = ["conv_id", "turn"]
    base = clauses.groupBy(*key).agg(
        F.min_by("role", "idx").alias("speaker"),
        F.count("*").alias("n_clauses"),
        F.sum("tenor_milli").alias("tenor_sum"),
        F.sum("modality_milli").alias("modality_sum"),
        F.count_if(trusted(F.col("annotation_source"))).alias("n_trusted"),
    )
    mood = first_seen_top(clauses, key, "mood", F.col("idx"))
    tally = clauses.groupBy(*key, "process_type").agg(F.count("*").alias("n"))
    tally = tally.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "process_type", F.col("n").cast("string")))), " ").alias("process_counts"))
    out = base.join(mood, key).join(tally, key)
    return out.withColumns({"avg_tenor": mean3(F.col("tenor_sum"), F.col("n_clauses")), "avg_modality": mean3(F.col("modality_sum"), F.col("n_clauses"))})


def _order() -> "Window":
    return Window.partitionBy("conv_id").orderBy("turn")


def shifts(turn_rows: DataFrame) -> DataFrame:
    """Changes against the turn before, in thousandths; null for a conversation's first."""
    tenor = F.round(F.col("avg_tenor") * 1000).cast("long")
    modality = F.round(F.col("avg_modality") * 1000).cast("long")
    w = _order()
    return turn_rows.withColumns({"tenor_shift_milli": tenor - F.lag(tenor).over(w), "modality_shift_milli": modality - F.lag(modality).over(w), "previous_speaker": F.lag("speaker").over(w)})


def direction(change: Column) -> Column:
    return F.when(change > 0, "increased").otherwise("decreased")


def significant_shifts(turn_rows: DataFrame, over: float = TENOR_SHIFT) -> DataFrame:
    s = shifts(turn_rows)
    return s.where(F.abs("tenor_shift_milli") > over * 1000).select("conv_id", "turn", "speaker", "tenor_shift_milli", direction(F.col("tenor_shift_milli")).alias("direction"))


def key_moments(turn_rows: DataFrame, coherence: DataFrame | None = None) -> DataFrame:
    """Tenor and modality shifts, and, given (conv_id, turn, coherence_milli), anomalies."""
    s = shifts(turn_rows)
    tenor = s.where(F.abs("tenor_shift_milli") > TENOR_SHIFT * 1000).select("conv_id", "turn", F.lit("tenor_shift").alias("type"), F.col("tenor_shift_milli").alias("magnitude_milli"))
    modality = s.where(F.abs("modality_shift_milli") > MODALITY_SHIFT * 1000).select("conv_id", "turn", F.lit("modality_shift").alias("type"), F.col("modality_shift_milli").alias("magnitude_milli"))
    out = tenor.unionByName(modality)
    if coherence is None:
        return out
    low = turn_rows.join(coherence, ["conv_id", "turn"]).where(F.col("coherence_milli") < COHERENCE * 1000)
    deflated = F.col("dominant_mood").isin("interrogative", "imperative") | (F.col("avg_modality") < 0.4) | (F.col("avg_tenor") < 0.4)
    odd = low.select("conv_id", "turn", F.when(deflated, "deflation_anomaly").otherwise("semantic_anomaly").alias("type"), F.col("coherence_milli").alias("magnitude_milli"))
    return out.unionByName(odd)


def speaker_profiles(turn_rows: DataFrame) -> DataFrame:
    """By speaker: turns, and mean, range and variance of tenor over turns with a trusted clause (null if none)."""
    t = turn_rows.withColumns({"ok": F.col("n_trusted") > 0, "tm": F.round(F.col("avg_tenor") * 1000).cast("long"), "mm": F.round(F.col("avg_modality") * 1000).cast("long")})
    first = t.groupBy("speaker").agg(
        F.count("*").alias("turn_count"),
        F.count_if("ok").alias("n_ok"),
        F.sum(F.when(F.col("ok"), F.col("tm"))).alias("ts"),
        F.sum(F.when(F.col("ok"), F.col("mm"))).alias("ms"),
        F.min(F.when(F.col("ok"), F.col("tm"))).alias("tenor_min_milli"),
        F.max(F.when(F.col("ok"), F.col("tm"))).alias("tenor_max_milli"),
        F.sum(F.when(F.col("ok"), F.col("tm") * F.col("tm"))).alias("sq"),
    )
    mean = F.floor(F.col("ts").cast("double") / F.col("n_ok") + 0.5).cast("long")  # thousandths
    spread = F.col("sq") - 2 * F.col("mean") * F.col("ts") + F.col("n_ok") * F.col("mean") * F.col("mean")  # millionths, about the rounded mean
    variance = F.when(F.col("n_ok") < 2, F.lit(0.0)).otherwise(F.floor(spread.cast("double") / F.col("n_ok") / 100 + 0.5) / 10000.0)
    out = first.withColumn("mean", F.when(F.col("n_ok") > 0, mean))
    return out.select(
        "speaker", "turn_count", (F.col("mean") / 1000.0).alias("avg_tenor"), "tenor_min_milli", "tenor_max_milli",
        F.when(F.col("n_ok") > 0, variance).alias("tenor_variance"), F.when(F.col("n_ok") > 0, mean3(F.col("ms"), F.col("n_ok"))).alias("avg_modality"),
    )


def mood_distribution(turn_rows: DataFrame) -> DataFrame:
    n = turn_rows.groupBy("speaker", "dominant_mood").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("speaker"))
    return n.select("speaker", "dominant_mood", "n", (F.floor(F.col("n") * 1000.0 / total + 0.5) / 1000.0).alias("share"))


def process_totals(clauses: DataFrame) -> DataFrame:
    return clauses.groupBy(F.col("role").alias("speaker"), "process_type").agg(F.count("*").alias("n"))


def process_stance(clauses: DataFrame) -> DataFrame:
    """By process: clauses, trusted ones, and the means of those (null if none)."""
    ok = trusted(F.col("annotation_source"))
    g = clauses.groupBy("process_type").agg(
        F.count("*").alias("clause_count"),
        F.count_if(ok).alias("annotated_count"),
        F.sum(F.when(ok, F.col("tenor_milli"))).alias("ts"),
        F.sum(F.when(ok, F.col("modality_milli"))).alias("ms"),
    )
    some = F.col("annotated_count") > 0
    return g.select("process_type", "clause_count", "annotated_count", F.when(some, mean3(F.col("ts"), F.col("annotated_count"))).alias("avg_tenor"), F.when(some, mean3(F.col("ms"), F.col("annotated_count"))).alias("avg_modality"))


def example_passages(turn_rows: DataFrame) -> DataFrame:
    """The most formal, casual, certain and hedged turn of each conversation, ties to the first."""
    pick = [
        ("Most Formal", F.max_by("turn", F.struct("avg_tenor", -F.col("turn")))),
        ("Most Casual", F.min_by("turn", F.struct("avg_tenor", "turn"))),
        ("Most Certain", F.max_by("turn", F.struct("avg_modality", -F.col("turn")))),
        ("Most Hedged", F.min_by("turn", F.struct("avg_modality", "turn"))),
    ]
    wide = turn_rows.groupBy("conv_id").agg(*[e.alias(f"p{i}") for i, (_, e) in enumerate(pick)])
    rows = F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"p{i}").alias("turn")) for i, (label, _) in enumerate(pick)])
    long = wide.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.label", "r.turn")
    values = turn_rows.select("conv_id", "turn", "speaker", "avg_tenor", "avg_modality")
    return long.join(values, ["conv_id", "turn"]).select("conv_id", "label", "turn", "speaker", F.when(F.col("label").isin("Most Formal", "Most Casual"), F.col("avg_tenor")).otherwise(F.col("avg_modality")).alias("value"))


def insights(turn_rows: DataFrame) -> DataFrame:
    """By conversation: the change of tenor from first to last turn with its reading, and the speaker of most turns."""
    ends = turn_rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.countDistinct("speaker").alias("n_speakers"),
        (F.round(F.max_by("avg_tenor", "turn") * 1000).cast("long") - F.round(F.min_by("avg_tenor", "turn") * 1000).cast("long")).alias("trend_milli"),
    )
    top = turn_rows.groupBy("conv_id", "speaker").agg(F.count("*").alias("n"), F.min("turn").alias("at"))
    top = top.groupBy("conv_id").agg(F.max_by(F.struct("speaker", "n"), F.struct("n", -F.col("at"))).alias("top"))
    reading = F.when(F.col("trend_milli") > 100, "increased").when(F.col("trend_milli") < -100, "decreased")
    several = F.col("n_speakers") > 1
    return ends.join(top, "conv_id").select("conv_id", "trend_milli", reading.alias("trend"), F.when(several, F.col("top.speaker")).alias("top_speaker"), F.when(several, F.col("top.n")).alias("top_turns"), "n_turns")


def timeline(turn_rows: DataFrame) -> DataFrame:
    """Tenor and its change by turn, with the 1-based place of the turn."""
    s = shifts(turn_rows)
    return s.select("conv_id", F.row_number().over(_order()).alias("turn_id"), "turn", "speaker", "avg_tenor", "tenor_shift_milli")


def field_evolution(clauses: DataFrame) -> DataFrame:
    return first_seen_top(clauses, ["conv_id", "turn"], "process_type", F.col("idx")).withColumnRenamed("dominant_process_type", "dominant_process")


def speaker_islands(rows: DataFrame, speaker: str = "role", text: str = "text", by: str = "conv_id", order: str = "turn") -> DataFrame:
    """Neighbouring rows of one speaker as one turn, their texts in order."""
    w = Window.partitionBy(by).orderBy(order)
    marked = rows.withColumn("__new", F.coalesce((F.col(speaker) != F.lag(speaker).over(w)).cast("int"), F.lit(1)))
    marked = marked.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = marked.groupBy(by, "island").agg(F.first(speaker).alias("speaker"), F.min(order).alias("first_turn"), F.count("*").alias("n_merged"), F.sort_array(F.collect_list(F.struct(F.col(order), F.col(text)))).alias("x"))
    return g.select(by, "island", "speaker", "first_turn", "n_merged", F.array_join(F.transform("x", lambda s: s[text]), " ").alias("merged_text"))


def first_seen(rows: DataFrame, value: str, by: str, order: str) -> DataFrame:
    """Distinct values by first place, 1-based."""
    firsts = rows.groupBy(by, value).agg(F.min(order).alias("first_at"))
    return firsts.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("first_at", value)))


def temporal_order(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Whether value never falls along order, by group."""
    w = Window.partitionBy(by).orderBy(order)
    back = F.coalesce(F.col(value) < F.lag(value).over(w), F.lit(False))
    return rows.withColumn("__back", back).groupBy(by).agg(F.count_if("__back").alias("n_backward"), (F.count_if("__back") == 0).alias("in_order"))


def coverage(clauses: DataFrame, by: list[str]) -> DataFrame:
    """Sources of annotation, and the share of clauses with a default, in percent with one place."""
    src = F.col("annotation_source")
    g = clauses.groupBy(*by).agg(F.count("*").alias("total"), *[F.count_if(src == s).alias(s) for s in ("llm", "human", "fallback", "stub", "chunk_artifact")], F.count_if(~trusted(src)).alias("defaulted"))
    return g.withColumn("defaulted_percent", F.floor(F.col("defaulted") * 1000.0 / F.col("total") + 0.5) / 10.0)


def reliable_means(clauses: DataFrame, by: list[str]) -> DataFrame:
    """Mean modality without clauses cut by chunking; 0.5 if none is left."""
    ok = F.col("annotation_source") != "chunk_artifact"
    g = clauses.groupBy(*by).agg(F.count_if(ok).alias("n_reliable"), F.sum(F.when(ok, F.col("modality_milli"))).alias("s"))
    return g.select(*by, "n_reliable", F.when(F.col("n_reliable") > 0, mean3(F.col("s"), F.col("n_reliable"))).otherwise(F.lit(0.5)).alias("avg_modality"))


def cohesion(tokens: DataFrame, by: list[str]) -> DataFrame:
    """From (by..., lemma, pos): repetition of content lemmas, and densities of conjunctions and pronouns.

    Tags are matched unanchored, so ADV also takes what contains it; 0 where
    there is nothing to count.
    """
    content = F.col("pos").rlike("NOUN|VERB|ADJ|ADV")
    g = tokens.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(content).alias("c"),
        F.countDistinct(F.when(content, F.lower("lemma"))).alias("u"),
        F.count_if(F.col("pos").rlike("CCONJ|SCONJ")).alias("conj"),
        F.count_if(F.col("pos").contains("PRON")).alias("pron"),
    )
    repeat = F.when(F.col("c") > 1, 1.0 - F.col("u") / F.col("c")).otherwise(0.0)
    return g.select(*by, repeat.alias("repetition_score"), (F.col("conj") / F.col("n")).alias("conjunction_density"), (F.col("pron") / F.col("n")).alias("pronoun_density"))


def chunk_boundaries(counts: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """The running offset at which each chunk begins."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("boundary", F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))


def chunk_artifacts(pieces: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """Pieces on either side of a cut inside a sentence."""
    from stancelake.functions.text import continues, terminal

    w = Window.partitionBy(by).orderBy(order)
    into = ~terminal(F.lag(text).over(w)) & continues(F.col(text)) & F.lag(text).over(w).isNotNull()
    marked = pieces.withColumn("__into", F.coalesce(into, F.lit(False)))
    after = F.coalesce(F.lead("__into").over(w), F.lit(False))
    return marked.withColumn("is_artifact", F.col("__into") | after).drop("__into")
