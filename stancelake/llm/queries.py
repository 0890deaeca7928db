"""The queries of the training-data operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stancelake.llm import ann, bpe, crf_quality, embed_dedup, html_density, mixing, packing, phrases, pii, secrets, simhash, token_index, turns
from stancelake.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the files stay where they are installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.links(table(spark, sf_dir, "embeddings"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op8_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.index_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(table(spark, sf_dir, "conversations"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_mixing": op2_mixing,
    "op3_html_density": op3_html_density,
    "op4_simhash": op4_simhash,
    "op5_pii": op5_pii,
    "op6_embed_dedup": op6_embed_dedup,
    "op7_ann": op7_ann,
    "op8_token_index": op8_token_index,
    "op9_packing": op9_packing,
    "op10_crf_quality": op10_crf_quality,
    "op11_bpe": op11_bpe,
    "op12_turn_repair": op12_turn_repair,
    "op13_phrases": op13_phrases,
}

#: The others can't be written as SQL: the tests hold them against brute force, round trips or held-out labels.
ORACLE_SQL: dict[str, str] = {"op13_phrases": phrases.SQL}
