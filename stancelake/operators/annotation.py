"""Annotation: batches through a pluggable annotator, contracts with defaults, traces, trust, cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.contracts import trusted, unit_interval
from stancelake.functions.labels import normalise
from stancelake.tables import settle

BATCH = 40
#: What an annotator adds to a clause.
PAYLOAD = ("process_type", "mood", "modality", "modality_milli", "tenor", "tenor_milli", "theme_type", "topical_theme", "annotation_source", "untrusted")
#: Tries in all, and with an annotator that asks to slow down; seconds between them double, up to LONGEST.
TRIES, TRIES_WHEN_BUSY, LONGEST = 3, 5, 30.0
#: Files that a round of a stream reads at most, and rounds that a long job is cut into.
FILES, ROUNDS = 64, 64
RAW = "clause_id string, mood_raw string, modality_raw double, tenor_raw double, theme_raw string"
#: A batch annotator: clauses' texts to (mood, modality, tenor, theme) or None for a miss, in order.
Batch = Callable[[list[str]], list[tuple[str, float, float, str] | None]]


def fallback() -> dict[str, Column]:
    """What a clause gets without an annotation."""
    return {"mood": F.lit("declarative"), "modality": F.lit(0.5), "tenor": F.lit(0.5), "annotation_source": F.lit("fallback")}


def stub() -> dict[str, Column]:
    """What a clause gets where only the first pass runs."""
    return {**fallback(), "annotation_source": F.lit("stub")}


class Busy(Exception):
    """An annotator that asks to be called later, after so many seconds if it says so."""

    def __init__(self, after: float | None = None):
        super().__init__(f"busy, again after {after} s")
        self.after = after


def delay(tried: int, after: float | None = None, first: float = 1.0) -> float:
    """Seconds to wait after so many tries: what was asked for, or else doubled each time; `LONGEST` at most."""
    return min(LONGEST, after if after is not None else first * 2 ** (tried - 1))


def with_retry(call: Batch, tries: int = TRIES, wait: Callable[[float], None] | None = None) -> Batch:
    """call again after an error, `tries` times in all (`TRIES_WHEN_BUSY` if it is Busy); then every clause of the batch is a miss.

    wait gets the seconds (time.sleep in production).
    """

    def run(texts: list[str]) -> list:
        tried = 0
        while True:
            tried += 1
            try:
                return call(texts)
            except Exception as e:
                busy = isinstance(e, Busy)
                if tried >= (max(tries, TRIES_WHEN_BUSY) if busy else tries):
                    return [None] * len(texts)
                if wait:
                    wait(delay(tried, e.after if busy else None))

    return run


def annotate(clauses: DataFrame, call: Batch, batch: int = BATCH) -> DataFrame:
    """(clause_id, raw values) for the clauses that the annotator answers, in batches of at most `batch`.

    Batches run on over the frames that Spark hands in, so a partition has one
    that is short at most. Answers come in order, or as (index, answer) pairs
    that say which clause of the batch they belong to; others are dropped.
    """
    names = ["clause_id", "mood_raw", "modality_raw", "tenor_raw", "theme_raw"]

    def answered(part: pd.DataFrame) -> list[tuple]:
        answers = list(call(part["ctext"].tolist()))
        if all(a is not None and len(a) == 2 and isinstance(a[0], int) for a in answers):
            by_index = {i: a for i, a in answers if 0 <= i < len(part)}
        else:
            by_index = dict(enumerate(answers[: len(part)]))
        ids = part["clause_id"].tolist()
        return [(ids[i], *a) for i, a in sorted(by_index.items(), key=lambda x: x[0]) if a is not None]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            held = pdf if held is None else pd.concat([held, pdf])
            full = len(held) // batch * batch
            if full:
                out = [x for at in range(0, full, batch) for x in answered(held.iloc[at : at + batch])]
                held = held.iloc[full:]
                yield pd.DataFrame(out, columns=names)
        if held is not None and len(held):
            yield pd.DataFrame(answered(held), columns=names)

    return clauses.select("clause_id", "ctext").mapInPandas(run, RAW)


def answered(clauses: DataFrame, calls: list[Batch], base: str, batch: int = BATCH, at_once: int = 1000, stop: Callable[[], bool] | None = None) -> tuple[DataFrame, bool]:
    """((raw answers and the attempt that gave them), whether all were asked), kept under base, a folder of the shared store.

    The clauses are written in files of whole batches, and a stream takes as
    many files as hold `at_once` batches at a time, asks, and writes the
    answers before the next ones: what is answered is never asked again, after
    a lost driver, a stop or another call for the same base, and a lost
    executor costs the files that its tasks were at. Rounds of many clauses
    hold more, so that there are ROUNDS of them or little more. The second of
    calls gets the clauses that the first left unanswered, and so on. stop is
    asked before every round. clauses must hold an id once, and be the same
    whenever base is.
    """
    spark = clauses.sparkSession
    names = ["clause_id", "ctext"]
    found, whole = [], True
    left, files = clauses.select(*names), min(at_once, FILES)
    schema = left.schema
    for attempt, call in enumerate(calls):
        at = f"{base}/attempt={attempt}"
        if not _exists(spark, f"{at}/asked/_SUCCESS"):
            rows = settle(left, "to-ask")
            each = batch * max(-(-at_once // files), -(-rows.count() // (batch * files * ROUNDS)))
            rows.write.mode("overwrite").option("maxRecordsPerFile", each).parquet(f"{at}/asked")
        halted = _rounds(annotate(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{at}/asked"), call, batch), at, stop)
        left = spark.read.schema(schema).parquet(f"{at}/asked")
        if _exists(spark, f"{at}/answers"):
            answers = spark.read.schema(RAW).parquet(f"{at}/answers/*")
            found.append(answers.withColumn("attempt", F.lit(attempt)))
            left = left.join(answers.select("clause_id").hint("merge"), "clause_id", "left_anti").select(*names)
        if halted:
            whole = False
            break
    empty = spark.createDataFrame([], RAW + ", attempt int")
    return reduce(lambda a, b: a.unionByName(b), found, empty), whole


class _Halt(Exception):
    pass


def _rounds(answers: DataFrame, at: str, stop: Callable[[], bool] | None) -> bool:
    """Whether the stream was halted between two of its rounds, each of which is a folder."""
    halted = []

    def put(rows: DataFrame, number: int) -> None:
        if stop is not None and stop():
            halted.append(number)
            raise _Halt
        rows.write.mode("overwrite").parquet(f"{at}/answers/round-{number}")

    query = answers.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not halted:
            raise
    return bool(halted)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def annotate_one(text: str, call: Batch) -> dict:
    """The payload of a single clause, by the same contract and defaults as a batch's."""
    spark = SparkSession.getActiveSession()
    row = spark.createDataFrame([("one", text)], "clause_id string, ctext string")
    answer = (list(call([text])) or [None])[0]
    raw = spark.createDataFrame([("one", *answer)] if answer is not None else [], RAW)
    return payloads(row, raw).first().asDict()


def payloads(clauses: DataFrame, raw: DataFrame) -> DataFrame:
    """Raw answers joined by id, each held to its contract; misses and broken answers get the defaults.

    The answers are written before anything reads them, so an annotator behind
    raw is asked once, and a clause's label and numbers come from one answer.
    """
    raw = settle(raw, "answers")
    j = clauses.join(normalise(normalise(raw, "mood_raw"), "theme_raw", "theme_type"), "clause_id", "left")
    ok = F.col("mood_raw_label").isNotNull() & unit_interval(F.col("modality_raw")) & unit_interval(F.col("tenor_raw"))
    d = fallback()
    out = {
        "mood": F.when(ok, F.col("mood_raw_label")).otherwise(d["mood"]),
        "modality": F.when(ok, F.col("modality_raw")).otherwise(d["modality"]),
        "tenor": F.when(ok, F.col("tenor_raw")).otherwise(d["tenor"]),
        "annotation_source": F.when(ok, "llm").otherwise(d["annotation_source"]),
        "theme_type": F.when(ok, F.col("theme_raw_label")).otherwise("unmarked"),
        "topical_theme": F.coalesce(F.regexp_extract("ctext", r"^\s*(\S+)", 1), F.lit("unknown")),
        "untrusted": F.coalesce((F.col("mood_raw_status") == "unknown") | (F.col("theme_raw_status") == "unknown"), F.lit(False)),
    }
    return j.select(*clauses.columns, *[c.alias(k) for k, c in out.items()])


def trace(premises: Column, rule: Column, conclusion: Column) -> Column:
    """SHA-256 of a canonical JSON: premises by type and source, the conclusion's keys in order."""
    ordered = F.array_sort(premises)
    pairs = F.map_from_entries(F.array_sort(F.map_entries(conclusion)))
    return F.sha2(F.to_json(F.struct(ordered.alias("premises"), rule.alias("inference_rule"), pairs.alias("conclusion"))), 256)


def cached(clauses: DataFrame, cache: DataFrame, call: Batch) -> tuple[DataFrame, DataFrame]:
    """(payloads of all clauses, what to add to the cache): only trusted results are reused and kept."""
    from stancelake.operators.catalog import cache_key, cache_split

    keyed = clauses.withColumn("cache_key", cache_key(F.col("section_id"), F.col("idx"), F.col("ctext")))
    usable = cache.where(trusted(F.col("annotation_source")))
    hits, misses = cache_split(keyed, usable)
    fresh = payloads(misses, annotate(misses, call))
    add = fresh.where(trusted(F.col("annotation_source"))).select(*usable.columns)
    return hits.unionByName(fresh, allowMissingColumns=True), add


def update_payload(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with new's non-null values."""
    n = new.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    j = old.join(n, key, "left")
    return j.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


def embeddings(rows: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(usable vectors with status embedded, others with failed and why): size and finite components are checked."""
    v = F.col(vector)
    why = F.when(v.isNull(), "no vector").when(F.size(v) != dim, "wrong size").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
    m = rows.withColumn("embedding_error", why)
    good = m.where("embedding_error is null").withColumn("embedding_status", F.lit("embedded"))
    return good, m.where("embedding_error is not null").withColumn("embedding_status", F.lit("failed"))


def redrive(clauses: DataFrame) -> DataFrame:
    """Whole sections that hold a clause without its vector."""
    gaps = clauses.where(F.col("embedding_status").isin("pending", "failed")).select("section_id").distinct()
    return clauses.join(gaps, "section_id", "left_semi")


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A deterministic stand-in for an embedder: signed counts of hashed words, unit length."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("i"), F.when(F.hash(w) % 2 == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter(places, lambda p: p["i"] == k), F.lit(0.0), lambda a, p: a + p["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))
