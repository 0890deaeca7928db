"""Catalog upkeep on immutable tables: upserts, purges, caches, queues, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str], when: Column | None = None) -> DataFrame:
    """old with new's values where keys meet (and `when` holds, over columns o_* and n_*), and new's other rows.

    A full outer join: one shuffle on the key. new must hold each key once.
    """
    o = old.select(F.col(key).alias("o_key"), *[F.col(c).alias(f"o_{c}") for c in columns])
    n = new.select(F.col(key).alias("n_key"), *[F.col(c).alias(f"n_{c}") for c in columns])
    j = o.join(n, F.col("o_key") == F.col("n_key"), "full_outer")
    takes = F.col("n_key").isNotNull() & (F.col("o_key").isNull() | (when if when is not None else F.lit(True)))
    did = F.when(F.col("o_key").isNull(), "inserted").when(F.col("n_key").isNotNull() & takes, "updated").otherwise("kept")
    return j.select(F.coalesce("o_key", "n_key").alias(key), *[F.when(takes, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in columns], did.alias("outcome"))


def replace_section(old: DataFrame, new: DataFrame, key: str = "section_id") -> DataFrame:
    """old without the sections of new, and new: the atomic replacement of whole sections."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def find_or_create(existing: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Names that don't exist yet, compared in lower case and trimmed; blanks are left out; the first spelling wins."""
    norm = F.lower(F.trim(F.col(name)))
    fresh = names.where(F.trim(F.col(name)) != "").withColumn("__n", norm).groupBy("__n").agg(F.min(F.trim(F.col(name))).alias(name))
    return fresh.join(existing.select(norm.alias("__n")).distinct(), "__n", "left_anti").select(name)


def cache_key(section: Column, idx: Column, text: Column) -> Column:
    return F.sha2(F.concat(section, idx.cast("string"), text), 256)


def cache_split(rows: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached values, misses)."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def review_queue(clauses: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Untrusted clauses that no review has accepted. Null-safe where NOT IN isn't."""
    from stancelake.operators.filters import untrusted

    accepted = reviews.where(F.col("decision") == "accepted").select(key)
    return clauses.where(untrusted(F.col("annotation_source"))).join(accepted, key, "left_anti")


def latest_decision(reviews: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last accepted or rejected decision of each row; re-annotations don't count."""
    kept = reviews.where(F.col("decision").isin("accepted", "rejected"))
    return kept.groupBy(by).agg(F.max_by("decision", F.struct(*order)).alias("decision"), F.count("*").alias("n_decisions"))


def descendant_counts(levels: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Counts of every level below the first, by its key. levels: (rows, key, parent key), from the top.

    Each level is summed under its parent before the next join, so no join
    carries more rows than the level above has.
    """
    rows, key, parent = levels[-1]
    counts = rows.groupBy(F.col(parent).alias("k")).agg(F.count("*").alias("n_0"))
    for depth, (rows, key, parent) in enumerate(reversed(levels[:-1]), start=1):
        own = rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).join(counts, "k", "left")
        below = [F.sum(F.coalesce(f"n_{i}", F.lit(0))).alias(f"n_{i}") for i in range(depth)]
        counts = own.groupBy(F.col("p").alias("k")).agg(*below, F.count("*").alias(f"n_{depth}"))
    return counts


def purge(table: DataFrame, doomed: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) of a table, by keys."""
    keys = doomed.select(key).distinct()
    return table.join(keys, key, "left_anti"), table.join(keys, key, "left_semi")


def ordinals(rows: DataFrame, by: str, order: list) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def located(sections: DataFrame, documents: DataFrame, collections: DataFrame, ids: DataFrame | None = None, few: int = 100_000) -> DataFrame:
    """(section_id, document_id, document, collection) of sections, or of those in ids(section_id); up to `few` ids are broadcast."""
    if ids is not None:
        wanted = ids.select("section_id").distinct()
        sections = sections.join(F.broadcast(wanted) if wanted.limit(few + 1).count() <= few else wanted, "section_id", "left_semi")
    d = documents.select("document_id", F.col("title").alias("document"), "collection_id")
    c = collections.select("collection_id", F.col("name").alias("collection"))
    return sections.select("section_id", "document_id").join(d, "document_id").join(c, "collection_id").select("section_id", "document_id", "document", "collection")


def section_owners(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """(section_id, document_id, collection_id): the document that a section stands in, and its collection."""
    return sections.select("section_id", "document_id").join(documents.select("document_id", "collection_id"), "document_id").select("section_id", "document_id", "collection_id")


def hit_places(hits: DataFrame, places: DataFrame, key: str = "section_id") -> DataFrame:
    """Search hits with their places; a hit without one keeps its row."""
    return hits.join(places, key, "left")


def section_counts(documents: DataFrame, sections: DataFrame, key: str = "document_id") -> DataFrame:
    """documents with section_count made anew; documents without sections have none."""
    n = sections.groupBy(key).agg(F.count("*").alias("__n"))
    return documents.join(n, key, "left").withColumn("section_count", F.coalesce("__n", F.lit(0))).drop("__n")


def documents_of(sections: DataFrame, section: str, order: str) -> DataFrame:
    """(document_key, newest, oldest, section_count) of sections, by what stands before the # of their ids."""
    key = F.split_part(F.col(section), F.lit("#"), F.lit(1)).alias("document_key")
    return sections.groupBy(key).agg(F.max(order).alias("newest"), F.min(order).alias("oldest"), F.count("*").alias("section_count"))


def distinct_of(rows: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """The distinct keys of rows, or of those that fit."""
    return (rows.where(condition) if condition is not None else rows).select(key).distinct()


def backfilled(artifacts: DataFrame, manifest: DataFrame, columns: list[str], key: str = "artifact_id") -> DataFrame:
    """artifacts with the manifest's columns; artifacts that it doesn't name keep nulls."""
    return artifacts.join(manifest.select(key, *columns), key, "left")


def newest(runs: DataFrame, n: int, started: str = "started_at", key: str = "run_id") -> DataFrame:
    """The n runs that started last, ties by key."""
    return runs.orderBy(F.desc(started), key).limit(n)


def rates(runs: DataFrame, done: str, failed: str, total: Column, elapsed_us: str) -> DataFrame:
    """runs with per_hour (three places) and eta_s: what the time so far says of the rest."""
    per_hour = F.floor(F.col(done) * 3_600_000_000.0 / F.col(elapsed_us) * 1000 + 0.5) / 1000.0
    eta = F.floor((total - F.col(done)) * (F.col(elapsed_us) / F.col(done)) / 1_000_000 + 0.5).cast("long")
    moving = (F.col(elapsed_us) > 0) & (F.col(done) > 0)
    return runs.withColumns({"per_hour": F.when(moving, per_hour), "eta_s": F.when(moving, eta)})


def enqueued(queue: DataFrame, items: DataFrame, key: str, at: str) -> DataFrame:
    """What to append to a review queue: items(key, reason) that it doesn't hold open already, pending since `at`; of equal keys the least reason."""
    fresh = items.where(F.col("reason").isNotNull()).groupBy(key).agg(F.min("reason").alias("reason"))
    open_ = queue.where("status = 'pending'").select(key)
    return fresh.join(open_, key, "left_anti").select(key, "reason", F.lit("pending").alias("status"), F.lit(at).cast("timestamp").alias("queued_at"))


def decisions(keys: DataFrame, decision: str, at: str) -> DataFrame:
    """Rows for the log of reviews: the keys, the decision and when."""
    if decision not in ("accepted", "rejected", "re_annotated"):
        raise ValueError(f"unknown decision {decision}")
    return keys.withColumns({"decision": F.lit(decision), "reviewed_at": F.lit(at).cast("timestamp")})


def content_decided(clauses: DataFrame, queue: DataFrame, decided: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clauses, queue) after decisions(section_id, decision) on contents.

    reject clears a section, edit replaces it by its rows in edited, approve
    changes the status alone; a section that isn't pending is left as it is.
    """
    pending = queue.where("status = 'pending'").select("section_id")
    d = decided.join(pending, "section_id", "left_semi").groupBy("section_id").agg(F.max("decision").alias("decision"))
    gone = d.where(F.col("decision").isin("reject", "edit")).select("section_id")
    fresh = edited.join(d.where("decision = 'edit'").select("section_id"), "section_id", "left_semi")
    kept = clauses.join(gone, "section_id", "left_anti").unionByName(fresh.select(*clauses.columns))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in {"reject": "rejected", "edit": "edited", "approve": "approved"}.items() for x in kv]), F.col("decision"))
    j = queue.join(d.select("section_id", status.alias("__s")), "section_id", "left")
    return kept, j.withColumn("status", F.when(F.col("status") == "pending", F.coalesce("__s", "status")).otherwise(F.col("status"))).drop("__s").select(*queue.columns)


def unresolved(files: DataFrame, reviews: DataFrame, key: str = "path") -> DataFrame:
    """files without those whose review has been decided."""
    return files.join(reviews.where("status <> 'pending'").select(key).distinct(), key, "left_anti")
