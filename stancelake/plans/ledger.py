"""Queries over commits, runs that fall silent, labelled trees and guarded moves, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stancelake.commits import Log
from stancelake.operators import catalog, graph
from stancelake.plans import queries as q
from stancelake.plans.queries import _TREE, query, read
from stancelake.streaming import runs
from stancelake.tables import scratch_path

# --- commits ------------------------------------------------------------------------------------


def _written(spark, d) -> Log:
    """Turns stored by section in four commits: all of them, replaced sections, a review with its payload, a purge."""
    log = Log(spark, scratch_path(spark, "ledger"), buckets=8)
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("section_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    log.commit(lambda t: t.append("turns", c, "section_id"), "load")
    shorter = c.where("section_id % 3 = 0 and turn % 2 = 0").withColumn("text", F.upper("role"))
    log.commit(lambda t: t.replace("turns", shorter), "replace")

    def review(t) -> None:
        some = t.peek("turns").where("section_id % 5 = 0 and turn = 0")
        t.merge("turns", some.select("section_id", F.lit("reviewed").alias("role")), "section_id", ["role"])
        t.append("reviews", catalog.decisions(some.select("section_id"), "accepted", q.AS_OF), "section_id")

    log.commit(review, "review")
    log.commit(lambda t: t.remove("turns", c.where("section_id % 7 = 0").select("section_id")), "purge")
    return log


_REPLACED = "SELECT conv_id AS section_id, turn::BIGINT AS turn, role, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE text END AS text FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 0"


@query(f"WITH w AS ({_REPLACED}) SELECT section_id, turn, CASE WHEN section_id % 5 = 0 AND section_id IN (SELECT section_id FROM w WHERE turn = 0) THEN 'reviewed' ELSE role END AS role, text FROM w WHERE section_id % 7 <> 0")
def committed_turns(spark, d):
    """A table after a log of writes."""
    return _written(spark, d).read("turns")


@query(f"WITH w AS ({_REPLACED}) SELECT section_id, 'accepted' AS decision, TIMESTAMP '{q.AS_OF}' AS reviewed_at FROM w WHERE section_id % 5 = 0 AND turn = 0")
def committed_reviews(spark, d):
    """The reviews that went in with their payloads."""
    return _written(spark, d).read("reviews").withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp_ntz"))


@query("SELECT conv_id AS section_id, turn::BIGINT AS turn, role FROM conversations")
def earlier_version(spark, d):
    """The same table as of its first commit, for a reader that has begun there."""
    return _written(spark, d).read("turns", 1).select("section_id", "turn", "role")


# --- runs ---------------------------------------------------------------------------------------

_STALLED, _DEAD, _LATE = 6 * 3600, 30 * 3600, 2 * 3600


@query(f"""WITH r AS (SELECT user_id::VARCHAR AS run, arg_max(event_type, (ts, event_id)) AS last_event, max(epoch_us(ts)) AS last_us, count(*) AS beats FROM events GROUP BY user_id), w AS (SELECT max(epoch_us(ts))//1000 - {_LATE * 1000} AS mark FROM events)
 SELECT run, last_us, beats, CASE WHEN last_event IN ('purchase','signup') THEN 'done' WHEN mark > last_us//1000 + {_DEAD * 1000} THEN 'dead' WHEN mark > last_us//1000 + {_STALLED * 1000} THEN 'stalled' ELSE 'running' END AS status FROM r, w""")
def live_runs(spark, d):
    """What the stream says last of every run: stalled and dead ones are told by timers, not by their next heartbeat."""
    status = F.when(F.col("event_type").isin("purchase", "signup"), "done").otherwise("running")
    events = runs.events_stream(spark, d).select(F.col("user_id").alias("run"), "ts", F.col("event_id").alias("tie"), status.alias("status"))
    rows = runs.run_through(runs.liveness(events, _STALLED, _DEAD, f"{_LATE} seconds"), "update")
    last = F.struct("at_us", (F.col("status") == "dead").alias("dead"))
    return rows.groupBy("run").agg(F.max_by(F.struct("last_us", "beats", "status"), last).alias("s")).select("run", "s.*")


# --- trees --------------------------------------------------------------------------------------


@query(f"WITH {_TREE}, b AS (SELECT ancestor AS node, count(*) AS n FROM up GROUP BY ancestor), d AS (SELECT node, max(level) AS depth, arg_max(ancestor, level) AS root FROM up GROUP BY node) SELECT e.node, coalesce(root, e.node) AS root, coalesce(depth, 0)::BIGINT AS depth, coalesce(n, 0)::BIGINT AS below FROM e LEFT JOIN b ON b.node = e.node LEFT JOIN d ON d.node = e.node")
def interval_labels(spark, d):
    """Root, depth and number of nodes below, all of them read off the labels."""
    return graph.intervals(q._tree(spark, d)).select("node", "root", "depth", ((F.col("post") - F.col("pre") - 1) / 2).cast("long").alias("below"))


@query(f"WITH {_TREE}, v AS (SELECT 'c'||c_custkey AS node, (c_custkey % 100)::BIGINT AS v FROM customer), o AS (SELECT node, node AS ancestor FROM e UNION ALL SELECT node, ancestor FROM up) SELECT o.ancestor AS node, coalesce(sum(v), 0)::BIGINT AS total FROM o LEFT JOIN v USING (node) GROUP BY 1")
def subtree_totals(spark, d):
    """A sum over everything below each node, along the tour."""
    v = read(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), (F.col("c_custkey") % 100).alias("v"))
    return graph.within(graph.intervals(q._tree(spark, d)), v, ["v"]).select("node", F.col("below_v").alias("total"))


#: Chains of a hundred parts; heads move under the middle of the next chain, three of four in a ring, the fourth onto a chain of the ring.
_MOVES = "SELECT p_partkey AS node, CASE (p_partkey // 100) % 4 WHEN 2 THEN p_partkey - 150 WHEN 3 THEN p_partkey - 250 ELSE p_partkey + 50 END AS parent, (p_partkey // 100) % 4 AS k FROM part WHERE p_partkey % 100 = 0"


@query(f"WITH RECURSIVE m AS ({_MOVES}), e AS (SELECT p_partkey AS node, p_partkey - 1 AS parent FROM part WHERE p_partkey % 100 <> 0 AND p_partkey > 1 UNION ALL SELECT node, parent FROM m), up(seed, upto) AS (SELECT node, parent FROM m UNION SELECT u.seed, e.parent FROM up u JOIN e ON e.node = u.upto) SELECT node, CASE WHEN EXISTS (SELECT 1 FROM up WHERE up.seed = m.node AND upto = m.node) THEN 'refused' ELSE 'admitted' END AS outcome FROM m")
def guarded_moves(spark, d):
    """Heads of chains that move under one another: refused where they close a ring through the chains' old edges."""
    k = F.col("p_partkey")
    p = read(spark, d, "part")
    old = p.select(k.alias("node"), F.when((k % 100 != 0) & (k > 1), k - 1).alias("parent"))
    at = F.floor(k / 100) % 4
    new = p.where(k % 100 == 0).select(k.alias("node"), F.when(at == 2, k - 150).when(at == 3, k - 250).otherwise(k + 50).alias("parent"))
    good, bad = graph.admitted(old, new)
    return good.select("node", F.lit("admitted").alias("outcome")).unionByName(bad.select("node", F.lit("refused").alias("outcome")))


# --- a folder of files --------------------------------------------------------------------------


def _folder(spark, d) -> str:
    """A file for every document, written by executors: by language and source, some hidden, some ignored by a rule of their folder, some of other types."""
    root = scratch_path(spark, "folder").removeprefix("file:")
    root = "/" + root.lstrip("/")
    k = F.col("doc_id")
    where = F.concat(F.when(k % 11 == 0, ".old/").otherwise(""), F.concat_ws("/", "lang", "source"), F.lit("/"), F.when(k % 5 == 0, "draft-").otherwise("doc-"), k.cast("string"), F.when(k % 3 == 0, ".txt").when(k % 7 == 0, ".bin").otherwise(".md"))

    def write(frames):
        import os

        made = set()
        for pdf in frames:
            for relative, i in zip(pdf["relative"], pdf["doc_id"], strict=True):
                path = f"{root}/{relative}"
                folder = os.path.dirname(path)
                if folder not in made:
                    made.add(folder)
                    os.makedirs(folder, exist_ok=True)
                    with open(os.path.join(folder, ".ignore"), "w", encoding="utf-8") as f:
                        f.write("draft-*\n")
                with open(path, "w", encoding="utf-8") as f:
                    f.write(f"# Heading {i}\n\nThe text of document {i} is long enough to be kept as a section of its own.\n\n## Below\n\nAnd this is the second one of {i}, which is as long as that and is kept too.\n")
            yield pdf[["doc_id"]]

    wide = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    read(spark, d, "documents").select("doc_id", where.alias("relative")).repartition(wide, "doc_id").mapInPandas(write, "doc_id long").count()
    return root


_FILES = "f AS (SELECT *, lang||'/'||source||'/'||CASE WHEN doc_id % 5 = 0 THEN 'draft-' ELSE 'doc-' END||doc_id||CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 7 = 0 THEN '.bin' ELSE '.md' END AS relative FROM documents)"


@query(f"WITH {_FILES} SELECT relative, CASE WHEN doc_id % 3 = 0 THEN 4 WHEN doc_id % 7 = 0 THEN 0 ELSE 2 END::BIGINT AS units, CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 0 THEN 'no loader' END AS problem FROM f WHERE doc_id % 11 <> 0 AND doc_id % 5 <> 0")
def folder_units(spark, d):
    """Units and problems of every file that a walk of the folder keeps."""
    from stancelake.sources import corpus

    root = _folder(spark, d)
    units, warnings, _ = corpus.load(spark, root)
    cut = lambda c: F.substring(F.col(c), len(root) + 2, 1 << 20)
    n = units.groupBy(cut("source_path").alias("relative")).agg(F.count("*").alias("units"))
    told = warnings.select(cut("path").alias("relative"), "problem")
    return n.join(told, "relative", "full_outer").select("relative", F.coalesce("units", F.lit(0)).cast("long").alias("units"), "problem")


@query("SELECT reason, n FROM (SELECT 'hidden' AS reason, count(*) FILTER (doc_id % 11 = 0) > 0 AS found, 1::BIGINT AS n FROM documents UNION ALL SELECT 'ignored', count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 = 0) > 0, count(*) FILTER (doc_id % 11 <> 0 AND doc_id % 5 = 0) FROM documents) WHERE found")
def folder_skips(spark, d):
    """What the walk leaves out, counted by reason: a hidden folder counts once, files that a rule names one by one."""
    from stancelake.sources import corpus

    return corpus.listed(spark, _folder(spark, d))[1]
