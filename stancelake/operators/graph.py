"""Trees and graphs: interval labels, paths, owners and selections of forests; closures, cycles and the guard of writes.

Ways of any length are doubled, so they take as many joins as the length has
bits. Every step is a written table, so neither the plan nor the lineage grows
with the depth. What a forest is asked needs no table of rows times depth:
labels make ancestry a range test, and sums run along the tour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stancelake.commits import Transaction
from stancelake.tables import settle


def ancestors(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, level) from (node, parent): all ancestors of every node (or of seeds(node)), nearest at level 1.

    `jump` holds everybody's ancestors 2**k levels up; what is known up to
    there gives, with one join, all twice as far. Depth has no limit. On a
    cycle every node is an ancestor of the others and of itself, at its least
    level; a node may have several parents.
    """
    jump = settle(edges.where("node is not null and parent is not null").select("node", F.col("parent").alias("up")).distinct(), "graph-jump")
    start = (seeds if seeds is not None else edges).where("node is not null").select("node").distinct()
    known = start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("level"))
    reach, nodes = 1, None
    while not jump.isEmpty():
        further = known.join(jump.select(F.col("node").alias("ancestor"), "up"), "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("level") + reach).alias("level"))
        known = settle(known.union(further), "graph-known")
        if nodes is None and reach >= 64:  # deep trees and cycles alike come here; a path without a cycle ends before all nodes
            nodes = edges.select("node").union(edges.select("parent")).distinct().count()
        if nodes is not None and reach > nodes:
            break
        jump = settle(jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.node")).select("a.node", "b.up").distinct(), "graph-jump")
        reach *= 2
        if nodes is not None:  # on cycles the same pair comes again at higher levels
            known = settle(known.groupBy("node", "ancestor", (F.col("level") == 0).alias("own")).agg(F.min("level").alias("level")).drop("own"), "graph-known")
    return known.where("level > 0").groupBy("node", "ancestor").agg(F.min("level").alias("level"))


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, descendant, level): everything below seeds(node), nearest at level 1."""
    turned = edges.where("parent is not null").select(F.col("parent").alias("node"), F.col("node").alias("parent"))
    return ancestors(turned, seeds).withColumnRenamed("ancestor", "descendant")


def one_parent(edges: DataFrame) -> DataFrame:
    """Distinct (node, parent) of a forest; parents that have no row of their own are roots; a node with two parents is an error."""
    e = edges.where("node is not null").select("node", "parent").distinct()
    roots = e.where("parent is not null").select(F.col("parent").alias("node")).distinct().join(e.select("node"), "node", "left_anti")
    e = settle(e.unionByName(roots.withColumn("parent", F.lit(None).cast(e.schema["parent"].dataType))), "graph-forest")
    n = F.count("parent")
    if not e.groupBy("node").agg(n.alias("n")).where("n > 1").isEmpty():
        raise ValueError("a node has more than one parent")
    return e.groupBy("node").agg(F.max("parent").alias("parent"))


def _lifted(start: DataFrame, columns: dict[str, Column], name: str, most: int = 64) -> DataFrame:
    """start(node, up, ...) with every row's way up doubled until it has ended (up is null), n rows a step.

    columns: how a column of a row (named a_*) and of the row that it has
    reached (b_*) give the doubled one. A way that doesn't end after
    2**most steps stands on a cycle, and is an error.
    """
    rows = settle(start, name)
    for _ in range(most):
        going = rows.where("up is not null")
        if going.isEmpty():
            return rows
        a = going.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns])
        b = rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
        further = a.join(b.hint("merge"), F.col("a_up") == F.col("b_node")).select(F.col("a_node").alias("node"), F.col("b_up").alias("up"), *[c.alias(k) for k, c in columns.items()])
        rows = settle(rows.where("up is null").select(*further.columns).unionByName(further), name)
    raise ValueError("the edges close a cycle")


def owners(edges: DataFrame, seeds: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """(node, owner): the nearest node of this kind at or above each of seeds(node), from kinds(node, kind).

    Ways end at a node of the kind, so no step has more rows than there are nodes.
    """
    of = kinds.where(F.col("kind") == kind).select("node").distinct().withColumn("__is", F.lit(True))
    start = one_parent(edges).join(of, "node", "left").select("node", F.when(F.col("__is"), None).otherwise(F.col("parent")).alias("up"), F.when(F.col("__is"), F.col("node")).alias("owner"))
    found = _lifted(start, {"owner": F.col("b_owner")}, "graph-owners", _rounds(start))
    return seeds.select("node").distinct().join(found.where("owner is not null").select("node", "owner"), "node")


def _rounds(rows: DataFrame) -> int:
    """Doublings that take any way without a cycle to its end."""
    return rows.count().bit_length() + 1


# --- interval labels -----------------------------------------------------------------------------


def running(rows: DataFrame, order: list[str], columns: list[str], name: str = "running") -> DataFrame:
    """rows with run_<column>: the sum of a column of longs up to and with the row, in the order given, which must be total.

    Rows are sorted by range, each task sums its own, and the totals of the
    tasks before, one row a task, are added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"run_{c}", T.LongType()) for c in columns], T.StructField("__task", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(columns, 0)
        task = TaskContext.get().partitionId()
        for batch in batches:
            more = []
            for c in columns:
                total = np.cumsum(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)) + so_far[c]
                so_far[c] = int(total[-1]) if len(total) else so_far[c]
                more.append(pa.array(total, pa.int64()))
            names = [*batch.schema.names, *[f"run_{c}" for c in columns], "__task"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, pa.array(np.full(batch.num_rows, task, dtype=np.int32))], names=names)

    own = settle(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, schema), name)
    totals = own.groupBy("__task").agg(*[F.sum(c).alias(c) for c in columns]).collect()  # a row a task
    before = []
    at = dict.fromkeys(columns, 0)
    for t in sorted(totals, key=lambda r: r["__task"]):
        before.append((t["__task"], *at.values()))
        at = {c: at[c] + (t[c] or 0) for c in columns}
    if not before:
        return own.drop("__task")
    ahead = F.broadcast(rows.sparkSession.createDataFrame(before, "__task int, " + ", ".join(f"__b_{c} long" for c in columns)))
    return own.join(ahead, "__task").select(*rows.columns, *[(F.col(f"run_{c}") + F.col(f"__b_{c}")).alias(f"run_{c}") for c in columns])


def intervals(edges: DataFrame) -> DataFrame:
    """(node, parent, root, depth, pre, post) of a forest: a node's interval holds those of all that stand below it, and of nothing else in its tree.

    An Euler tour goes down into a node and up out of it. A node's place in it
    is its parent's, one more, and two for every node below its earlier
    siblings, so sizes, depths and places are doubled along the ways up: as
    many joins as the depth has bits, a row a node. Siblings are in the order
    of their names; pre and post count backwards from the tour's end and are
    negative. Children of one parent are numbered by range, not in one group.
    """
    sized = _sized(one_parent(edges))
    # siblings stand together in the order (parent, node); first is what was counted before them
    placed = settle(running(sized.select("parent", "node", "size"), ["parent", "node"], ["size"], "graph-order"), "graph-place")
    first = placed.where("parent is not null").groupBy("parent").agg(F.min(F.col("run_size") - F.col("size")).alias("first"))
    start = placed.join(first, "parent", "left").select(
        "node", "parent", "size", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("node")).alias("root"),
        F.col("parent").isNotNull().cast("long").alias("depth"), F.when(F.col("parent").isNotNull(), 1 + 2 * (F.col("run_size") - F.col("size") - F.col("first"))).otherwise(0).alias("at"),
    )
    deep = {"parent": F.col("a_parent"), "size": F.col("a_size"), "root": F.col("b_root"), "depth": F.col("a_depth") + F.col("b_depth"), "at": F.col("a_at") + F.col("b_at")}
    found = _lifted(start, deep, "graph-tour", _rounds(start))
    total = found.where("parent is null").select("root", F.col("size").alias("total"))
    return found.join(total, "root").select("node", "parent", "root", "depth", (F.col("at") - 2 * F.col("total")).alias("pre"), (F.col("at") + 2 * F.col("size") - 1 - 2 * F.col("total")).alias("post"))


def _sized(forest: DataFrame) -> DataFrame:
    """(node, parent, size) of one_parent's rows: how many nodes stand below a node, itself included.

    A step adds to a node the sums of those that stand its length below it,
    which know as much below themselves.
    """
    rows = settle(forest.select("node", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "graph-sizes")
    for _ in range(_rounds(rows)):
        got = rows.where("up is not null").groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("more"))
        if got.isEmpty():
            return rows.select("node", "parent", "size")
        going = rows.where("up is not null")
        above = going.select(F.col("node").alias("up"), F.col("up").alias("further")).join(got.select(F.col("node").alias("up")).hint("merge"), "up", "left_semi")
        hopped = going.join(above.hint("merge"), "up", "left").select("node", "parent", F.col("further").alias("up"), "size")
        all_rows = hopped.unionByName(rows.where("up is null"))  # what has ended has no key to meet by
        rows = settle(all_rows.join(got.hint("merge"), "node", "left").select("node", "parent", "up", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")), "graph-sizes")
    raise ValueError("the edges close a cycle")


def within(labels: DataFrame, marks: DataFrame, columns: list[str]) -> DataFrame:
    """(node, parent, above_<c>, below_<c>): sums of columns of marks(node, ...) over a node and all above it, and over it and all below it.

    Sums run along the tour: what a node adds on the way down it takes back on
    the way up, or what was added between the two is what stands below.
    """
    j = labels.join(marks.groupBy("node").agg(*[F.sum(c).cast("long").alias(c) for c in columns]), "node", "left")
    value = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    at = lambda place, sign: F.struct("root", F.col(place).alias("at"), "node", F.lit(sign).alias("side"), *[(value(c) * sign).alias(f"o_{c}") for c in columns], *[(value(c) if sign > 0 else F.lit(0).cast("long")).alias(f"t_{c}") for c in columns])
    tour = j.select(F.inline(F.array(at("pre", 1), at("post", -1))))
    r = running(tour, ["root", "at"], [x for c in columns for x in (f"o_{c}", f"t_{c}")], "graph-sums")
    down, up = F.col("side") == 1, F.col("side") == -1
    sums = [x for c in columns for x in (F.max(F.when(down, F.col(f"run_o_{c}"))).alias(f"above_{c}"), (F.max(F.when(up, F.col(f"run_t_{c}"))) - F.max(F.when(down, F.col(f"run_t_{c}") - F.col(f"t_{c}")))).alias(f"below_{c}"))]
    return labels.select("node", "parent").join(r.groupBy("node").agg(*sums), "node")


# --- the guard of writes -------------------------------------------------------------------------


def admitted(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of new that may be written, those that would stand on a cycle) when every node of new(node, parent) gets that parent in place of its old one.

    On the way up from a new parent, old edges hold as far as the next node
    that moves; so the nodes that move, each with the next one that its new
    parent stands below, decide alone. Old edges are walked once, by doubling
    that ends at such nodes, and no closure is made. A node that moves twice
    in one batch is an error.
    """
    kept = [F.col(c) for c in new.columns]
    moves = settle(new.where("node is not null and parent is not null"), "graph-moves")
    if not moves.groupBy("node").count().where("count > 1").isEmpty():
        raise ValueError("a node moves more than once")
    marks = moves.select("node", F.lit("moves").alias("kind"))
    known = old.select("node", "parent").unionByName(moves.select("node", F.lit(None).cast(old.schema["parent"].dataType).alias("parent"))).unionByName(moves.select(F.col("parent").alias("node"), F.lit(None).cast(old.schema["parent"].dataType).alias("parent")))
    known = known.groupBy("node").agg(F.max("parent").alias("parent"))
    up = owners(known, moves.select(F.col("parent").alias("node")), marks, "moves").withColumnRenamed("node", "parent")
    jumps = moves.join(up, "parent", "left").select("node", F.col("owner").alias("parent"))
    on = settle(cycles(jumps.where("parent is not null")), "graph-cycles")
    return moves.join(on, "node", "left_anti").select(*kept), moves.join(on, "node", "left_semi").select(*kept)


def move(t: Transaction, name: str, new: DataFrame) -> None:
    """Give nodes of the stored table name(node, parent) new parents, within a commit: all of them, or a ValueError if some would close a cycle.

    The check reads the table as of the commit, so of two moves that close a
    cycle together the later one is checked again, and refused.
    """
    old = t.read(name)
    if old is None:
        old = new.limit(0).select("node", "parent")
    good, bad = admitted(old, new)
    if not bad.isEmpty():
        raise ValueError(f"cycle at {bad.first()['node']}")
    t.replace(name, good.select("node", "parent").unionByName(new.where("parent is null").select("node", "parent")), "node")


def selection_counts(states: DataFrame) -> DataFrame:
    """(full, partial, none): how many nodes are in each state."""
    return states.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("full", "partial", "none")])


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes that are no node's parent."""
    return edges.select("node").distinct().join(edges.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that are their own ancestor, at any distance; (node, parent), a node may have several parents.

    With one parent each, the parents are doubled. What is reached after some
    steps holds what is reached after more; where twice the steps reach as
    many nodes, every one of them has one before it there, and they are the
    cycles. So it takes as many joins as the longest tail or path has bits.
    Otherwise the closure is doubled until it is whole.
    """
    e = settle(edges.where("node is not null and parent is not null").select("node", "parent").distinct(), "graph-edges")

    def hop(up: DataFrame) -> DataFrame:
        return up.alias("a").join(up.alias("b").hint("merge"), F.col("a.parent") == F.col("b.node")).select("a.node", "b.parent")

    if e.groupBy("node").count().where("count > 1").isEmpty():
        was, now = None, e.select("parent").distinct().count()
        while now != was:
            e = settle(hop(e), "graph-hop")
            was, now = now, e.select("parent").distinct().count()
        return e.select(F.col("parent").alias("node")).distinct()
    was, now = 0, e.count()
    while now != was:
        e = settle(e.union(hop(e)).distinct(), "graph-closure")
        was, now = now, e.count()
    return e.where("node = parent").select("node").distinct()


def paths(edges: DataFrame, label: str = "label", joiner: str = " > ") -> DataFrame:
    """(node, depth, path): labels from the root to the node, folded down by doubling: a row a node in every step; null labels are left out."""
    named = edges.where("node is not null").groupBy("node").agg(F.first(label, ignorenulls=True).cast("string").alias("own"))
    start = one_parent(edges).join(named, "node", "left").select("node", F.col("parent").alias("up"), F.lit(0).alias("depth"), F.when(F.col("own").isNull(), F.array().cast("array<string>")).otherwise(F.array("own")).alias("way"))
    found = _lifted(start, {"depth": F.col("a_depth") + F.col("b_depth") + 1, "way": F.concat("b_way", "a_way")}, "graph-paths", _rounds(start))
    return found.select("node", "depth", F.array_join("way", joiner).alias("path"))


def widened(nodes: DataFrame, edges: DataFrame, text: str = "text") -> DataFrame:
    """(node, evidence): a node's text with its ancestors' before it, from the root on."""
    texts = nodes.select("node", F.col(text).alias("label"))
    told = edges.select("node", "parent").join(texts, "node", "left")
    return nodes.select("node").join(paths(told, "label", " ").select("node", F.col("path").alias("evidence")), "node")


def matching(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """hits(node) and all nodes above them: those with a hit below."""
    n = within(intervals(edges), hits.select("node", F.lit(1).alias("hit")), ["hit"])
    return hits.select("node").unionByName(n.where("below_hit > 0").select("node")).distinct()


def selection(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(node, state): full, partial or none, from the leaves that are chosen(node) themselves or below a chosen node."""
    labels = settle(intervals(edges), "graph-labels")
    up = within(labels, chosen.select("node").distinct().withColumn("chosen", F.lit(1)), ["chosen"])
    leaf = up.join(leaves(edges), "node", "left_semi")
    marks = leaf.select("node", F.lit(1).alias("leaf"), (F.col("above_chosen") > 0).cast("int").alias("taken"))
    n = within(labels, marks, ["leaf", "taken"])
    return n.select("node", F.when(F.col("below_taken") == F.col("below_leaf"), "full").when(F.col("below_taken") > 0, "partial").otherwise("none").alias("state"))
