"""Conversations brought into order: faults counted, and the cheapest edits that make turns alternate.

A conversation is right if the initials of its roles read `(s?(ua)+)?`: an
optional system turn, then user and assistant in turn. A forward Viterbi
programme runs over that grammar's four states (nothing yet, after system,
after user, after assistant) and carries the least (cost, audit string) of
each; after every turn its layer is closed by insertions, two at most, since
a third would come back to where it was. Two audits of one state and cost are
never one the other's beginning, so the least audit of a whole is made of the
least audits of its parts.

That makes the programme a product of parts: turns are sorted by range, a
stretch of a conversation gives the least (cost, audit) from every state to
every other, and a fold over stretches finds the path. So a conversation may
be longer than a task should read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import settle, slots

#: Costs of the edits, and of leaving a truncated turn in place.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Edits of a stretch, rows and bytes of text of a batch that a task hands on.
STRETCH, ROWS, BYTES = 4096, 10_000, 8 << 20
BLANKS = " \t\n\x0b\x0c\r"

Best = tuple[int, str]
Layer = list[Best | None]


def close(v: Layer) -> Layer:
    """A layer with what up to two insertions of a user's or an assistant's turn reach."""
    for _ in range(2):
        to_user = [x for x in (v[NOTHING], v[SYSTEM], v[ASSISTANT]) if x]
        user = min(([v[USER]] if v[USER] else []) + [(c + INSERT, a + "I") for c, a in to_user], default=None)
        assistant = min(([v[ASSISTANT]] if v[ASSISTANT] else []) + ([(v[USER][0] + INSERT, v[USER][1] + "I")] if v[USER] else []), default=None)
        v = [v[NOTHING], v[SYSTEM], user, assistant]
    return v


def step(v: Layer, initial: str, cut: bool) -> Layer:
    """The layer after a turn without a fault, or a truncated one, that is kept, given another role or deleted."""
    out: Layer = [(x[0] + DELETE, x[1] + "D") if x else None for x in v]
    extra = TRUNCATED if cut else 0

    def put(to: int, x: Best, letter: str) -> None:
        cost = x[0] + extra + (REROLE if letter == "R" else 0)
        best = out[to]
        if best is None or cost < best[0] or (cost == best[0] and x[1] + letter < best[1]):
            out[to] = cost, x[1] + letter

    for state, x in enumerate(v):
        if x is None:
            continue
        if state == USER:
            put(ASSISTANT, x, "K" if initial == "a" else "R")
        else:
            put(USER, x, "K" if initial == "u" else "R")
        if state == NOTHING and initial == "s":
            put(SYSTEM, x, "K")
    return close(out)


def drop(v: Layer, n: int) -> Layer:
    """The layer after n turns that must go; of insertions of equal cost the last place is the least audit."""
    return close([(x[0] + DELETE * n, x[1] + "D" * n) if x else None for x in v])


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text): rows harmed by crc32(`conv:turn`) % 20, nulls as one blank: 0 lost, 1 emptied, 2 without . ! ?, 3 twice, 4 from a user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    d = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), how.alias("how")).where("how <> 0")
    d = d.withColumn("text", F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    d = d.withColumn("role", F.when(F.col("how") == 4, "user").otherwise(F.col("role")))
    return d.select("conv", "turn", "role", "text", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def marked(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, role, text), nulls of role and text as one blank, with the text's mark, by which rows of one turn and role are ordered."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select("conv", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")).withColumn("mark", F.unhex(F.md5(F.col("text").cast("binary"))))


ORDER = ["conv", "turn", "role", "mark"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, mark, n, blank, cut, first) of marked rows: equal rows once, with their number, and whether they are the first of their role and text.

    Everything is a partial aggregate over keys that hold the turn, so neither
    a long conversation nor a text that it repeats gathers in one task.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    m = rows.select(*ORDER, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    once = settle(m.groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")), "turn-once")
    early = once.groupBy("conv", "role", "mark").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("t"))
    early = early.select("conv", F.col("t.turn").alias("turn"), "role", "mark", F.lit(0).cast("long").alias("n"), F.lit(False).alias("blank"), F.lit(False).alias("cut"), F.lit(True).alias("first"))
    both = once.withColumn("first", F.lit(False)).unionByName(early)
    return both.groupBy(*ORDER).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("cut").alias("cut"), F.max("first").alias("first"))


def stretches(found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row for each stretch of a conversation, in the order (task, block): its counts, its ends, and its best way from state to state."""
    kind = found.schema["conv"].dataType.simpleString()
    schema = (
        f"conv {kind}, task int, block int, turn long, role string, mark binary, low long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
        "first_initial string, last_initial string, ways array<struct<at:int,to:int,cost:long,audit:string>>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, own, ways = TaskContext.get().partitionId(), None, None, []
        target = None

        def ended() -> dict:
            own["ways"] = [{"at": i, "to": j, "cost": x[0], "audit": x[1]} for i, layer in enumerate(ways) for j, x in enumerate(layer) if x]
            return own

        for batch in batches:
            names = ["conv", "turn", "role", "mark", "n", "blank", "cut", "first"]
            if target is None:
                t = {n: batch.schema.field(n).type for n in ("conv", "turn", "role", "mark")}
                longs = pa.int64()
                way = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32()), ("cost", longs), ("audit", pa.string())]))
                target = pa.schema([("conv", t["conv"]), ("task", pa.int32()), ("block", pa.int32()), ("turn", t["turn"]), ("role", t["role"]), ("mark", t["mark"]), ("low", longs), ("last_turn", longs), ("turns", longs), ("blank", longs), ("duplicate", longs), ("truncated", longs), ("illegal", longs), ("first_initial", pa.string()), ("last_initial", pa.string()), ("ways", way)])
            out: list[dict] = []
            for c, turn, role, mark, n, blank, cut, first in zip(*[batch.column(x).to_pylist() for x in names], strict=True):
                initial = role[:1]
                if own is not None and (c != conv or own["letters"] >= stretch):
                    out.append(ended())
                    block = own["block"] + 1 if c == conv else 0
                    own = None
                elif own is None:
                    block = 0
                if own is None:
                    conv = c
                    own = {"conv": c, "task": task, "block": block, "turn": turn, "role": role, "mark": mark, "low": turn, "last_turn": turn, "turns": int(turn is not None), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first_initial": initial, "last_initial": None, "letters": 0}
                    ways = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
                if turn is not None and turn != own["last_turn"]:
                    own["turns"] += 1
                    own["low"] = turn if own["low"] is None else own["low"]
                own["last_turn"] = turn
                own["illegal"] += (own["last_initial"] is not None and _illegal(own["last_initial"], initial)) + (n - 1) * _illegal(initial, initial)
                own["last_initial"] = initial
                own["letters"] += n
                gone = n if blank else n - first
                own["blank" if blank else "duplicate"] += gone
                if not blank and first:
                    own["truncated"] += cut
                    ways = [step(v, initial, cut) for v in ways]
                if gone:
                    ways = [drop(v, gone) for v in ways]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if own is not None:
            yield pa.RecordBatch.from_pylist([ended()], schema=target)

    order = [F.asc_nulls_first(c) for c in ORDER]
    return found.repartitionByRange(slots(found.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _illegal(one: str, two: str) -> bool:
    return one + two not in ("su", "ua", "au")


class _Node:
    """One stretch of a path: its edits, the state it was entered in, and the path before it."""

    __slots__ = ("before", "entered", "edits")

    def __init__(self, before: "_Node | None", entered: int, edits: str):
        self.before, self.entered, self.edits = before, entered, edits


def _spelt_less(a: _Node | None, b: _Node | None) -> bool:
    """Whether path a's audit is less than that of b; both have as many stretches, and what they share is not looked at."""
    one, two = [], []
    while a is not b:
        one.append(a.edits)
        two.append(b.edits)
        a, b = a.before, b.before
    return "".join(reversed(one)) < "".join(reversed(two))


def folded(parts: DataFrame) -> DataFrame:
    """The best path through the stretches of each conversation: one row a stretch, the last one with the conversation's counts, cost and audit.

    A task streams its conversations; of one it holds the letters of the edits
    alone, four ways at most, which the audit column has to hold anyway.
    """
    kind = parts.schema["conv"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv {kind}, task int, block int, turn long, role string, mark binary, state int, before long, edits string, {', '.join(c + ' long' for c in counts)}, audit string"

    def whole(rows: list[dict], paths: list[tuple[int, _Node] | None]) -> list[dict]:
        cost, node = paths[NOTHING] or (None, None)
        end = paths[ASSISTANT]
        if cost is None or (end is not None and (end[0] < cost or (end[0] == cost and _spelt_less(end[1], node)))):
            cost, node = end
        nodes: list[_Node] = []
        while node is not None:
            nodes.append(node)
            node = node.before
        root, *nodes = reversed(nodes)  # the root holds what is inserted before the first turn
        nodes[0].entered, nodes[0].edits = NOTHING, root.edits + nodes[0].edits
        at = 0
        for r, x in zip(rows, nodes, strict=True):
            r |= {"state": x.entered, "before": at, "edits": x.edits}
            at += len(x.edits) - x.edits.count("D")
        turns = [t for r in rows for t in (r["low"], r["last_turn"]) if t is not None]  # nulls come first, so a stretch's first turn may be none
        several, last = 0, None
        for r in rows:  # a turn that two stretches share counts once
            several += r["turns"] - (last is not None and r["turn"] == last)
            last = r["last_turn"]
        illegal = sum(r["illegal"] for r in rows) + sum(_illegal(a["last_initial"], b["first_initial"]) for a, b in zip(rows, rows[1:]))
        rows[-1] |= {"gaps": max(turns) - min(turns) + 1 - several if turns else 0, "cost": cost, "audit": "".join(x.edits for x in nodes)} | {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")} | {"illegal": illegal}
        for r in rows[:-1]:
            r |= dict.fromkeys([*counts, "audit"])
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        paths: list[tuple[int, _Node] | None] = []
        target = None
        for batch in batches:
            if target is None:
                t = {n: batch.schema.field(n).type for n in ("conv", "turn", "role", "mark")}
                target = pa.schema([("conv", t["conv"]), ("task", pa.int32()), ("block", pa.int32()), ("turn", t["turn"]), ("role", t["role"]), ("mark", t["mark"]), ("state", pa.int32()), ("before", pa.int64()), ("edits", pa.string()), *[(c, pa.int64()) for c in counts], ("audit", pa.string())])
            out: list[dict] = []
            for r in batch.to_pylist():
                if not rows or rows[-1]["conv"] != r["conv"]:
                    if rows:
                        out += whole(rows, paths)
                    rows = []
                    paths = [(x[0], _Node(None, NOTHING, x[1])) if x else None for x in close([(0, ""), None, None, None])]
                further: list[tuple[int, _Node] | None] = [None] * 4
                for w in r.pop("ways"):
                    if (old := paths[w["at"]]) is None:
                        continue
                    cost, node = old[0] + w["cost"], _Node(old[1], w["at"], w["audit"])
                    best = further[w["to"]]
                    if best is None or cost < best[0] or (cost == best[0] and _spelt_less(node, best[1])):
                        further[w["to"]] = cost, node
                paths = further
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=target)
        if rows:
            yield pa.RecordBatch.from_pylist(whole(rows, paths), schema=target)

    n = slots(parts.sparkSession)
    return parts.repartition(n, "conv").sortWithinPartitions(F.asc_nulls_first("conv"), "task", "block").mapInArrow(run, schema)


def plan(rows: DataFrame) -> DataFrame:
    """The edits of marked rows, as a written table; see folded."""
    return settle(folded(stretches(faults(rows))), "turn-edits")


def summary(edits: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows."""
    return edits.where("audit is not null").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def repaired(rows: DataFrame, edits: DataFrame, split: bool = True) -> DataFrame:
    """(conv, position, role, text, edit): the turns after the edits, inserted ones with an empty text.

    Edits come in the order of the turns, so a task streams both side by side.
    With `split`, a conversation whose turns lay in several tasks of `plan` is
    dealt to as many again: where they begin is broadcast, one row a task at
    most. Without, a conversation's turns come out one after another.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    cols = [*ORDER, "text", "kind", "state", "before", "edits"]
    texts = rows.select(*ORDER, "text", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("state"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("string").alias("edits"))
    both = edits.select(*ORDER, F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"), "state", "before", "edits").unionByName(texts)
    key: list[Column | str] = ["conv"]
    if split:
        place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", "mark")
        begins = edits.groupBy("conv", "task").agg(F.min(place).alias("b")).groupBy("conv").agg(F.array_sort(F.collect_list("b")).alias("bounds")).where(F.size("bounds") > 1)
        begins = begins.select(F.col("conv").alias("of"), "bounds")
        both = both.join(F.broadcast(begins), F.col("conv").eqNullSafe(F.col("of")), "left")
        both = both.withColumn("part", F.coalesce(F.size(F.filter("bounds", lambda b: b <= place)), F.lit(0))).drop("of", "bounds")
        key, cols = ["conv", "part"], [*cols, "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        size, conv, part, state, at, letters, p = 0, None, None, NOTHING, 0, "", 0
        names, open_ = cols, False
        target = None

        def put(role: str, text: str, edit: str) -> None:
            nonlocal state, at, size
            if state == NOTHING and edit == "K" and role[:1] == "s":
                state = SYSTEM
            else:
                state = ASSISTANT if state == USER else USER
            for column, x in zip(out, (conv, at, role, text, edit), strict=True):
                column.append(x)
            at += 1
            size += len(text)

        def insertions() -> None:
            nonlocal p
            while p < len(letters) and letters[p] == "I":
                put("assistant" if state == USER else "user", "", "I")
                p += 1

        def flushed() -> pa.RecordBatch:
            nonlocal size
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)
            for c in out:
                c.clear()
            size = 0
            return batch

        for batch in batches:
            if target is None:
                target = pa.schema([("conv", batch.schema.field("conv").type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
            for r in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                c, role, text, is_text, entered, before, edits_ = r[0], r[2], r[4], r[5], r[6], r[7], r[8]
                own_part = r[9] if split else 0
                if not is_text:
                    insertions()  # those that end the stretch before
                    if not open_ or c != conv or own_part != part:
                        state, at = entered, before
                    conv, part, letters, p, open_ = c, own_part, edits_, 0, True
                    continue
                insertions()
                edit = letters[p]
                p += 1
                if edit == "K":
                    put(role, text, "K")
                elif edit == "R":
                    put("assistant" if state == USER else "user", text, "R")
                if len(out[0]) >= ROWS or size >= BYTES:
                    yield flushed()
        insertions()
        if out[0]:
            yield flushed()

    ordered = [F.asc_nulls_first(c) for c in [*key, *ORDER[1:], "kind"]]
    dealt = both.select(*cols).repartition(slots(rows.sparkSession), *key).sortWithinPartitions(*ordered)
    return dealt.mapInArrow(run, f"conv {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv, sha256) of turns that come one after another: `role:text`, joined by line ends. A chained hash is one task's work for each conversation."""
    kind = turns.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, conv, target = None, None, None

        def row(c: object, x: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], target.field(0).type), pa.array([x])], schema=target)

        for batch in batches:
            target = target or pa.schema([("conv", batch.schema.field("conv").type), ("sha256", pa.string())])
            done: list[tuple] = []
            for c, role, text in _triples(batch):
                if h is None or c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    h, conv = hashlib.sha256(), c
                else:
                    h.update(b"\n")
                h.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], target.field(0).type), pa.array([x[1] for x in done])], schema=target)
        if h is not None:
            yield row(conv, h.hexdigest())

    return turns.select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha256 string")


def _triples(batch: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*[batch.column(n).to_pylist() for n in ("conv", "role", "text")], strict=True)


def report(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every conversation of rows, damaged first: its faults, the cheapest repair and the repaired text's hash.

    A null conversation id is a conversation of its own; null turns come
    first; null roles and texts are one blank, which is no role and a blank
    text; ties of a turn are in the order of role and a hash of the text, so
    equal rows stand together; a conversation of any length and repeated rows
    count whole; one that loses all its rows has zeros, an empty audit and the
    hash of nothing; an empty table gives no rows; other columns are not
    looked at.
    """
    harmed = marked(damage(rows, conv, turn, role, text))
    edits = plan(harmed)
    hashes = digests(repaired(harmed, edits, split=False))
    parts = rows.select(F.col(conv).alias("conv")).distinct().unionByName(summary(edits), allowMissingColumns=True).unionByName(hashes, allowMissingColumns=True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    g = parts.groupBy("conv").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return g.withColumnRenamed("conv", conv)
