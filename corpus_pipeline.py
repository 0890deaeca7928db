"""A corpus pipeline of five stages over `documents`, each one an operator of stancelake.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next one's docs. All but the last return
the columns of documents, so that a stage's decisions are all that changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.llm import crf_quality, mixing, near_copies, packing, pii
from stancelake.llm.common import discard, settle, table
from stancelake.llm.queries import vocabulary

#: Shares of the tokens after mixing; a document is taken once at most.
WEIGHTS = {"clean": 0.98, "junk": 0.01, "toxic": 0.01}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is predicted to be good.

    Null and empty texts are scored like any other, long ones whole; ids may be
    null or repeat; an empty table gives no rows; extra columns stay. Fitted on
    the labelled documents of sf_dir, not on docs.
    """
    model = crf_quality.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return crf_quality.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies by SimHash: the one with the smallest id.

    Null, empty and blank texts are copies of one another; rows are decided one
    by one, ties of an id by the text's hash, and of repeated rows one stays;
    null ids come last; an empty table gives no rows; extra columns stay.
    """
    return near_copies.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by the kind in brackets; n_chars follows the text.

    Null texts and their n_chars stay as they are; of spans that overlap the
    first one counts; rows keep their number, repeated ones and those without
    an id too; an empty table gives no rows; extra columns stay.
    """
    out = pii.redact(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to WEIGHTS.

    A document stays once or not at all; equal rows share their fate; null and
    empty texts weigh nothing and are drawn by their posterior's rate; an empty
    table gives no rows; extra columns stay.
    """
    return mixing.draw(docs, table(spark, sf_dir, "labels"), WEIGHTS, most=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids and their places in sequences.

    A null or empty text is its end id alone; long ones are cut into as many
    pieces as it takes; null and repeated ids have pieces of their own; an empty
    table gives no rows.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("redact", redact), ("mix", mix), ("pack", pack)]

#: Trained models, fingerprints and tokenizers can't be written as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    written: list[str] = []
    for name, stage in STAGES[:-1]:
        before = [*written]
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}", written)
        discard(spark, before)
        written = written[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
