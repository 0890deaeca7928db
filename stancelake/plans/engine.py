"""One object over the whole: compile, retrieve, analyse, assess, review, export."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.commits import Log, Transaction
from stancelake.operators import annotation, catalog, clauses as cl, conversation as cv, filters, graph, kb, retrieval, sinks
from stancelake.sources import corpus
from stancelake.sources.loaders import RECORDS, catalogue, section_shape, text_files

Annotator = Callable[[DataFrame], DataFrame]


class Engine:
    """Tables live under base as Parquet; annotators are functions of a clause table (`surface` is a test instrument)."""

    def __init__(self, spark: SparkSession, base: str, annotate: Annotator = cl.annotate_lexicon):
        self.spark, self.base, self.annotate = spark, base.rstrip("/"), annotate
        self.loaders = catalogue()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def load(self, path: str, loader: str, **options) -> DataFrame:
        """Units of the files at path by one loader; readers of records (csv, json) take the path itself, and options."""
        make = self.loaders.resolve(loader)
        return make(self.spark, path, **options) if loader in RECORDS else make(text_files(self.spark, path), **options)

    def load_folder(self, root: str, ignore: list[str] | None = None, **how) -> tuple[DataFrame, DataFrame]:
        """(units, warnings(path, problem)): every file of a folder by the loader of its type; see corpus.load."""
        units, warnings, _ = corpus.load(self.spark, root, ignore, **how)
        return units, warnings

    def compile(self, units: DataFrame) -> DataFrame:
        """Units to annotated clauses with stable ids."""
        rows = self.annotate(cl.split_clauses(units))
        return rows.withColumn("stable_id", cl.stable_id(F.col("section_id"), F.col("idx"), F.col("ctext")))

    @property
    def log(self) -> Log:
        return Log(self.spark, self.base)

    def read(self, name: str) -> DataFrame | None:
        """A stored table as of the last commit."""
        return self.log.read(name)

    def store(self, clauses: DataFrame, name: str = "clauses") -> int:
        """Replace whole sections in one commit; others may store other sections at the same time."""
        return self.log.commit(lambda t: t.replace(name, clauses, "section_id"), "store")

    def decide(self, clause_id: str, decision: str, at: str, annotate: Annotator | None = None, clauses: str = "clauses", reviews: str = "reviews") -> int:
        """Record a review decision; re_annotated runs the annotator over the clause and replaces its payload, in the same commit."""

        def change(t: Transaction) -> None:
            rows = t.peek(clauses)
            one = rows.where(F.col("clause_id") == clause_id) if rows is not None else None
            if one is None or one.isEmpty():
                raise KeyError(f"no clause {clause_id}")
            if decision == "re_annotated":
                fresh = (annotate or self.annotate)(one.drop(*annotation.PAYLOAD))
                kept = [c for c in annotation.PAYLOAD if c in rows.columns and c in fresh.columns]
                t.merge(clauses, fresh.select("section_id", "clause_id", *kept), "clause_id", kept)
            t.append(reviews, catalog.decisions(one.select("clause_id"), decision, at), "clause_id")

        return self.log.commit(change, decision)

    def sections(self, units: DataFrame) -> DataFrame:
        return section_shape(units)

    def find(self, clauses: DataFrame, limit: int = 50, offset: int = 0, **conditions) -> tuple[DataFrame, int]:
        return filters.page(filters.apply(clauses, **conditions), ["section_id", "idx"], limit, offset)

    def retrieve(self, clauses: DataFrame, vectors: DataFrame, query: list[float], words: list[str], limit: int = 10, **conditions) -> DataFrame:
        """Filter first, then two lists of three times the limit, then fusion. clauses and vectors share `id`."""
        kept = filters.apply(clauses, **conditions)
        near = retrieval.vector_top(vectors.join(kept.select("id"), "id", "left_semi"), query, limit * retrieval.CANDIDATES, "id", "vector")
        said = retrieval.keyword_top(kept, words, limit * retrieval.CANDIDATES, "id", "ctext")
        return retrieval.fuse(near, said, limit)

    def analyse(self, clauses: DataFrame) -> dict[str, DataFrame]:
        """The frames of a conversation analysis, by name."""
        t = cv.turns(clauses)
        return {
            "turns": t, "moments": cv.key_moments(t), "profiles": cv.speaker_profiles(t), "moods": cv.mood_distribution(t), "stance": cv.process_stance(clauses),
            "passages": cv.example_passages(t), "insights": cv.insights(t), "timeline": cv.timeline(t), "fields": cv.field_evolution(clauses), "coverage": cv.coverage(clauses, ["conv_id"]),
        }

    def report(self, clauses: DataFrame) -> str:
        a = self.analyse(clauses)
        return sinks.report_markdown(a["profiles"], a["stance"], a["moments"])

    def assess(self, clauses: DataFrame, by: str) -> DataFrame:
        """Quality and bucket of artifacts of unknown age."""
        g = kb.artifacts(clauses, by)
        q = kb.quality_milli(F.col("source_sum"), F.col("modality_sum"), F.col("n"), F.lit(0.5))
        return g.withColumn("quality_milli", q).withColumn("bucket", kb.bucket(F.col("quality_milli")))

    def graph(self, clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes, and the parent-child edges of clauses that have a parent."""
        nodes = clauses.select(F.col("clause_id").alias("id"), "ctext", "process_type", "mood")
        parent = clauses.where("parent_clause_id is not null") if "parent_clause_id" in clauses.columns else clauses.limit(0).withColumn("parent_clause_id", F.lit(None).cast("string"))
        return nodes, parent.select(F.col("parent_clause_id").alias("source"), F.col("clause_id").alias("target"), F.lit("parent_child").alias("edge_type"))

    def ancestors(self, edges: DataFrame) -> DataFrame:
        return graph.ancestors(edges)

    def review_queue(self, clauses: DataFrame, reviews: DataFrame) -> DataFrame:
        return catalog.review_queue(clauses, reviews, "clause_id")
