"""Fixed vocabularies of the data model, and the checks that keep rows inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
MOODS = ("declarative", "interrogative", "imperative", "exclamative", "indicative", "minor", "fragment")
PROCESSES = ("material", "mental", "relational", "verbal", "behavioral", "existential")
THEMES = ("unmarked", "marked", "interrogative", "imperative", "multiple", "topical", "simple", "existential", "clausal", "textual", "interjection", "interpersonal", "predicated", "predicator", "circumstantial")
SOURCES = ("llm", "fallback", "stub", "chunk_artifact", "human")
TRUSTED = ("llm", "human")
EMBEDDING_STATES = ("pending", "embedded", "failed", "not_applicable")
CONTENT_TYPES = ("technical_reference", "tutorial", "research_note", "code_snippet", "ai_generated", "draft", "index", "image", "unknown")
ACTIONS = ("keep", "update", "merge_candidate", "archive", "review")
DECISIONS = ("accepted", "rejected", "re_annotated")
QUEUE_DECISIONS = ("approve", "edit", "reject")
MOMENTS = ("tenor_shift", "modality_shift", "topic_shift", "deflation_anomaly", "semantic_anomaly")

TOKEN = "struct<text:string,lemma:string,pos:string,tag:string,dep:string,head_index:int,morphology:map<string,string>,index:int>"
GROUP = "struct<id:string,type:string,text:string,head_token_index:int,token_indices:array<int>>"
UNIT = "section_id string, document_key string, source_path string, parent_section_id string, text string, heading string, speaker string, is_user boolean, sent_at timestamp, metadata map<string,string>"


def trusted(source: Column) -> Column:
    return source.isin(*TRUSTED)


def unit_interval(x: Column) -> Column:
    """A finite number from 0 to 1; null and NaN fail."""
    return F.coalesce(~F.isnan(x) & x.between(0.0, 1.0), F.lit(False))


def violations() -> dict[str, Column]:
    """What is wrong with a clause row, by rule."""
    return {
        "mood": ~F.coalesce(F.col("mood").isin(*MOODS), F.lit(False)),
        "process_type": ~F.coalesce(F.col("process_type").isin(*PROCESSES), F.lit(False)),
        "annotation_source": ~F.coalesce(F.col("annotation_source").isin(*SOURCES), F.lit(False)),
        "modality": ~unit_interval(F.col("modality")),
        "tenor": ~unit_interval(F.col("tenor")),
    }


def quarantine(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every rule, rows that break one with the rules they break)."""
    broken = F.filter(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in violations().items()]), lambda x: x.isNotNull())
    marked = clauses.withColumn("violations", broken)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)
