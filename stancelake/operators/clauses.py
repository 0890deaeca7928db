"""Clauses of units, and the two deterministic annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.contracts import MOODS, PROCESSES
from stancelake.functions import lexicon

#: Runs up to and with their end marks. A match can only begin where a run does, which keeps lines without an end mark linear.
SENTENCE = r"(?<![^.!?\n])[^.!?\n]++[.!?]++"


def turn_units(conversations: DataFrame) -> DataFrame:
    """Conversation rows as units: one a turn."""
    section = F.concat(F.col("conv_id").cast("string"), F.lit("#turn-"), F.col("turn").cast("string"))
    return conversations.select("conv_id", "turn", F.col("role").alias("speaker"), section.alias("section_id"), "text")


def split_clauses(units: DataFrame, *keep: str) -> DataFrame:
    """One row a sentence: section_id, clause_id, idx, ctext, and the columns to keep. Units without sentences give none."""
    rows = units.select(*keep, "section_id", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("idx", "ctext"))
    return rows.withColumn("idx", F.col("idx").cast("long")).withColumn("clause_id", F.concat("section_id", F.lit(":"), F.col("idx").cast("string")))


def stable_id(section: Column, idx: Column, text: Column) -> Column:
    """A deterministic id, so that recomputed partitions agree."""
    return F.sha2(F.concat_ws("|", section, idx.cast("string"), text), 256)


def surface(clauses: DataFrame) -> DataFrame:
    """A test instrument: payloads from counts of letters, words and commas alone, in integers.

    It makes every enum value and every kind of source occur on texts that
    hold no real words. It says nothing about language.
    """
    text = F.col("ctext")
    letters = F.length(F.regexp_replace(text, "[^A-Za-zÀ-ÿ]", "")).cast("long")
    words = F.size(F.regexp_extract_all(text, F.lit(r"[^ \n]+"), F.lit(0))).cast("long")
    commas = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))).cast("long")
    seat = F.pmod(F.xxhash64("clause_id"), F.lit(10)) if "conv_id" not in clauses.columns else (F.col("conv_id") * 31 + F.col("turn") * 7 + F.col("idx")) % 10
    df = clauses.withColumns({"letters": letters, "words": words, "commas": commas})
    return df.withColumns(
        {
            "tenor_milli": F.least(F.lit(1000).cast("long"), F.expr("(100 * letters) div greatest(words, 1)")),
            "modality_milli": F.greatest(F.lit(0).cast("long"), 1000 - 500 * F.col("commas")),
            "mood": F.element_at(F.array(*[F.lit(m) for m in MOODS]), (F.col("words") % len(MOODS) + 1).cast("int")),
            "process_type": F.element_at(F.array(*[F.lit(p) for p in PROCESSES]), (F.col("letters") % len(PROCESSES) + 1).cast("int")),
            "annotation_source": F.when(seat <= 5, "llm").when(seat == 6, "human").when(seat == 7, "fallback").when(seat == 8, "stub").otherwise("chunk_artifact"),
        }
    )


def annotate_lexicon(clauses: DataFrame) -> DataFrame:
    """The default for real text: modality by marker, mood by punctuation and first word, process by verb lists.

    A clause with a marker is `lexicon`, one without `fallback` with neutral numbers.
    """
    text = F.col("ctext")
    band = F.col("__band")
    first = F.regexp_extract(F.lower(text), r"^\s*([a-z']+)", 1)
    return clauses.withColumn("__band", lexicon.band(text)).withColumns(
        {
            "modality": F.when(band == "low", 0.2).when(band == "median", 0.5).when(band == "high", 0.9).otherwise(0.5),
            "tenor": F.lit(0.5),
            "mood": F.when(F.rtrim(text).endswith("?"), "interrogative").when(F.rtrim(text).endswith("!"), "exclamative").when(first.isin("please", "let"), "imperative").otherwise("declarative"),
            "process_type": lexicon.process_of_text(text),
            "annotation_source": F.when(band.isNotNull(), "lexicon").otherwise("fallback"),
        }
    ).drop("__band")


def separate(clauses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three stored shapes: clauses, what was said, how it was said."""
    base = clauses.select("clause_id", "section_id", "idx", "ctext")
    said = clauses.select("clause_id", "process_type")
    how = clauses.select("clause_id", "mood", "modality_milli", "tenor_milli", "annotation_source")
    return base, said, how


def rejoin(base: DataFrame, said: DataFrame, how: DataFrame) -> DataFrame:
    """The three-way equi-join on clause_id."""
    return base.join(said, "clause_id").join(how, "clause_id")


def rejoin_embedded(vectors: DataFrame, base: DataFrame, said: DataFrame, how: DataFrame) -> DataFrame:
    """The four-way join of retrieval, from the vectors: clauses without one are no candidates."""
    return vectors.join(base, "clause_id").join(said, "clause_id").join(how, "clause_id")


def parse(text: Column) -> Column:
    """Tokens of a clause by plain rules: i, text, lemma, pos, tag, dep, head; a parser that knows the language plugs in instead.

    The root is the first listed verb, or else the first word. The word before
    it is its subject, the word after it its object; every other token hangs
    on the root.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}']+|[^\s\p{L}\p{N}']"), F.lit(0))
    word = lambda t: t.rlike(r"^[\p{L}\p{N}']")
    verb = lambda t: lexicon.is_verb(t)
    roots = F.filter(F.transform(tokens, lambda t, i: F.when(verb(t), i)), lambda i: i.isNotNull())
    words = F.filter(F.transform(tokens, lambda t, i: F.when(word(t), i)), lambda i: i.isNotNull())
    root = F.coalesce(F.get(roots, F.lit(0)), F.get(words, F.lit(0)), F.lit(0))

    def token(t: Column, i: Column) -> Column:
        pos = F.when(~word(t), "PUNCT").when(t.rlike(r"^\p{N}+$"), "NUM").when(verb(t), "VERB").otherwise("NOUN")
        tag = F.when(F.lower(t).isin("might", "may", "must", "can", "could", "should", "would", "will"), "MD").otherwise(F.substring(pos, 1, 2))
        dep = F.when(i == root, "ROOT").when(~word(t), "punct").when(i == root - 1, "nsubj").when(i == root + 1, "dobj").otherwise("dep")
        return F.struct(i.cast("int").alias("i"), t.alias("text"), lexicon.lemma(t).alias("lemma"), pos.alias("pos"), tag.alias("tag"), dep.alias("dep"), root.cast("int").alias("head"))

    return F.transform(tokens, token)


def transitivity(tokens: Column) -> Column:
    """The root's text, lemma, pos and tag, and every token's text, dep, pos and tag."""
    root = F.get(F.filter(tokens, lambda t: t["dep"] == "ROOT"), F.lit(0))
    deps = F.transform(tokens, lambda t: F.struct(*[t[k].alias(k) for k in ("text", "dep", "pos", "tag")]))
    return F.struct(F.struct(*[root[k].alias(k) for k in ("text", "lemma", "pos", "tag")]).alias("root"), deps.alias("dependencies"))
