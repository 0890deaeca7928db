"""Conversation repair, against a search backwards from the end and, on short ones, against all edits there are."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from stancelake.llm import turns
from stancelake.llm.queries import op12_turn_repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def harmed(rows):
    """{conv: rows after damage}: rows are (conv, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(how, text)
        kept += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def moves(state, row, fault):
    """(cost, letter, next state, role or None) for one row."""
    yield 2, "D", state, None
    if fault in ("blank", "duplicate"):
        return
    more = 5 if fault == "truncated" else 0
    initial = row[1][:1]
    for after, role in {"": [("u", "user")], "s": [("u", "user")], "u": [("a", "assistant")], "a": [("u", "user")]}[state]:
        if initial == after:
            yield more, "K", after, row[1]
        yield more + 1, "R", after, role
    if state == "" and initial == "s":
        yield more, "K", "s", row[1]


def inserted(state):
    return {"": ("u", "user"), "s": ("u", "user"), "u": ("a", "assistant"), "a": ("u", "user")}[state]


def best(rows, marks):
    """(cost, audit, repaired turns) by recursion from the end."""
    known = {}

    def rest(i, state, room):
        if (i, state, room) not in known:
            found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if room:
                after, role = inserted(state)
                c = rest(i, after, room - 1)
                found += [(c[0] + 5, "I" + c[1], (f"{role}:", *c[2]))] if c else []
            if i < len(rows):
                for cost, letter, after, role in moves(state, rows[i], marks[i]):
                    c = rest(i + 1, after, 3)
                    found += [(c[0] + cost, letter + c[1], (f"{role}:{rows[i][2]}", *c[2]) if role is not None else c[2])] if c else []
            known[i, state, room] = min(found, key=lambda x: x[:2], default=None)
        return known[i, state, room]

    for i in reversed(range(len(rows) + 1)):  # so that no call goes deep
        for state in ("", "s", "u", "a"):
            rest(i, state, 3)
    return rest(0, "", 3)


def expected(rows):
    out = {}
    for conv, kept in harmed(rows).items():
        marks = faults(kept)
        numbers = [t for t, _, _ in kept if t is not None]
        cost, audit, repaired = best(kept, marks)
        initials = [r[:1] for _, r, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def some_rows(seed, n):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in r.sample([None, *range(12)], r.randint(1, 9)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"])
            rows.append((conv, turn, role, r.choice(["Well.", "Well.", "And then", "Yes! ", " \t", "", None, "x?\n", f"t{turn}."])))
    return rows


@pytest.mark.parametrize("stretch", [1, 3, turns.STRETCH])
def test_report_equals_search(spark, stretch, monkeypatch):
    monkeypatch.setattr(turns.stretches, "__defaults__", (stretch,))
    rows = some_rows(stretch, 150)
    rows += [(900, t, "user" if t % 2 else "assistant", f"Text {t % 50}.") for t in range(400)]  # longer than a task's share
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    assert got(turns.report(df)) == expected(rows)


def test_all_edits_of_short_conversations():
    r = random.Random(3)
    for _ in range(150):
        rows = [(t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b.", "c", ""])) for t in range(r.randint(0, 3))]
        marks = faults(rows)
        found = []
        for places in itertools.product(range(3), repeat=len(rows) + 1):
            paths = [(0, "", "")]
            for i in range(len(rows) + 1):
                paths = [(c + 5 * places[i], a + "I" * places[i], _far(s, places[i])) for c, a, s in paths]
                if i < len(rows):
                    paths = [(c + cost, a + letter, after) for c, a, s in paths for cost, letter, after, _ in moves(s, rows[i], marks[i])]
            found += [(c, a) for c, a, s in paths if s in ("", "a")]
        layer = turns.close([(0, ""), None, None, None])
        for (_, role, _), mark in zip(rows, marks, strict=True):
            layer = turns.drop(layer, 1) if mark in ("blank", "duplicate") else turns.step(layer, role[:1], mark == "truncated")
        assert min(x for x in (layer[turns.NOTHING], layer[turns.ASSISTANT]) if x) == min(found) == best(rows, marks)[:2]


def _far(state, n):
    for _ in range(n):
        state = inserted(state)[0]
    return state


def test_split_conversations_give_the_same_turns(spark):
    rows = some_rows(8, 20) + [(900, t, ["user", "assistant", "user"][t % 3], f"Text {t % 90}.") for t in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    harmed_rows = turns.marked(turns.damage(df))
    edits = turns.plan(harmed_rows)
    assert edits.where("conv = 900").select("task").distinct().count() > 1
    whole, parts = ({(r.conv, r.position): (r.role, r.text, r.edit) for r in turns.repaired(harmed_rows, edits, split=s).collect()} for s in (False, True))
    assert whole == parts
    for conv in (900, None):
        mine = [f"{role}:{text}" for (c, _), (role, text, _) in sorted(whole.items(), key=lambda x: x[0][1]) if c == conv]
        assert hashlib.sha256("\n".join(mine).encode()).hexdigest() == expected(rows)[conv][-1]


def test_empty_lost_and_wide_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert turns.report(spark.createDataFrame([], schema)).count() == 0
    lost = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    assert got(turns.report(spark.createDataFrame([(7, lost, "user", "Hi.")], schema))) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    wide = spark.createDataFrame([(1, 2, "user", "Hi.", 5, "x", 1)], schema + ", conv long, mark string, task int")
    assert got(turns.report(wide)) == expected([(1, 2, "user", "Hi.")])


def test_repeated_and_long_rows(spark):
    long = "word " * 200_000 + "."
    rows = [(1, 0, "user", "Same.")] * 700 + [(1, 1, "assistant", long), (1, 2, "user", long[:-1])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(turns.report(df)) == expected(rows)


def test_query_covers_every_conversation(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op12_turn_repair(spark, data)) == expected(rows)
