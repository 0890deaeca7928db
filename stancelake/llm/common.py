"""What the training-data operators share: tables, the shared folder, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancelake.tables import remove, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    Unlike a cache or a local checkpoint, it outlives any executor. paths
    gets the table's place, for those who discard it before the end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        remove(spark, path)
    paths.clear()


def slots(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs, for partitions sorted by their first `keys` columns; a run is held until it is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        differs = np.zeros(n, dtype=bool)
        for c in batch.columns[:keys]:
            x = c.to_numpy(zero_copy_only=False)
            differs |= x != x[-1]
        last = np.flatnonzero(differs)
        cut = int(last[-1]) + 1 if len(last) else 0  # where the last run of this batch begins
        if not cut and held and all(held[-1].column(i)[-1].as_py() == batch.column(i)[0].as_py() for i in range(keys)):
            held.append(batch)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def deal(rows: DataFrame, key: list[str], by: str, block: int, name: str, also: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """A function that adds one, two and chunk to rows with the keys of these rows, for keys of over `block` rows (or over 1 by `also`).

    A hot key's rows are cut into chunks by a hash of `by`, and each pair of
    chunks (one <= two) gets both; every pair of rows meets in at least one
    pair of chunks. There are at most rows / block hot keys; they are
    broadcast up to 100,000 of them, and joined beyond.
    """
    size = F.count("*") / block if also is None else F.greatest(F.count("*") / block, also)
    hot = settle(rows.groupBy(*key).agg(F.ceil(size).cast("int").alias("chunks")).where("chunks > 1"), name)
    few = hot.count() <= 100_000

    def chunks(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(hot) if few else hot, key, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        df = df.withColumn("chunk", F.pmod(F.xxhash64(by), F.col("chunks")).cast("int"))
        df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        return df.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("other", "chunks")

    return chunks


def connected_components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node reachable.

    Alternating large-star and small-star steps, each a partially aggregated
    minimum and an equi-join. Both sides of a join are written tables, so that
    Spark can split the rows of a node with very many links among tasks.
    Nothing is collected but one fingerprint of the edge table a round. Null
    ends are dropped.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    spark, own, old = edges.sparkSession, [], []
    e = settle(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name, old)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").cast("decimal(38,0)"))).first()

    was = mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        # large star: u hands its larger neighbours its least neighbour
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name, old)
        large = settle(e.join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct(), name, old)
        # small star: u and its smaller neighbours go to the least of them
        low = settle(large.groupBy("b").agg(F.min("a").alias("m")), name, old)
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        e = settle(small.where("a <> b").distinct(), name, own)
        discard(spark, old)
        old, own = own, old
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    own = e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(own)
