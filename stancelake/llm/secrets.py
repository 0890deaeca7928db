"""Secrets in texts: fixed patterns, and a guess-cost search on values in credential context.

Three base kinds are plain patterns (see `KINDS`). The method adds a fourth,
`guess`: a value that stands where a credential would (after a word such as
pwd, passphrase or auth and a separator) is cut into the segments that are
cheapest to guess: dictionary words, dates, repeats, keyboard walks and spans
of brute force. The search is a dynamic programme over end positions and
segment counts: cost(end, count) adds up the logarithms of the segments'
guesses, and a cut into c segments has c! orders to try, as in published
password strength estimators. A value whose cheapest cut still needs at least
10**`LEAST` guesses is reported.

The dictionary is a short list of password words, and after it the words of a
public tokenizer's vocabulary in its order, which is that of their frequency:
tens of thousands of words, so that ordinary prose isn't taken for a secret.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

#: A credential's word, then a separator, then the value; words in either case.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code|key)?|pwd|passwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|client[ _-]?secret|auth(?:[ _-]?(?:key|token))?|bearer|credentials?|login|pin)["']?\x20*(?::=|=>|[:=]|\bis\b)\x20*["']?([!-~]{8,})""",
    re.I | re.A,
)
#: log10 of the guesses from which a value is a secret.
LEAST = 10.0

# Common password words, most frequent first.
WORDS = """password qwerty dragon letmein monkey football iloveyou admin welcome login master hello princess
sunshine shadow baseball superman michael jordan trustno1 batman access mustang jennifer hunter soccer killer
charlie secret summer winter spring autumn flower freedom whatever computer internet cheese coffee orange
banana purple silver golden diamond magic ninja default guest root test user changeme temp demo sample
example server database system manager office company love god sex money star happy lucky angel baby
the and for you not with this that have from your are was one our out""".split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Words of a vocabulary are at most so long; longer ones are cut up like anything else.
LONGEST_WORD = 24
LEET = str.maketrans("@4301!$5+7", "aaeoiisstt")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {(a, b) for row in ROWS for a, b in zip(row, row[1:])} | {(up[i], low[j]) for up, low in zip(ROWS[1:], ROWS[2:]) for i in range(len(up)) for j in (i - 1, i) if 0 <= j < len(low)}
_BESIDE |= {(b, a) for a, b in _BESIDE}
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")


@lru_cache(maxsize=4)
def dictionary(path: str | None) -> Mapping[str, int]:
    """Ranks of words: the password words, then the whole words of a byte-level vocabulary file, in its order."""
    rank = dict(RANK)
    if path:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        for token in sorted(ids, key=ids.get):
            word = token[1:].lower()
            if token[0] == "\u0120" and 3 <= len(word) <= LONGEST_WORD and word.isascii() and word.isalpha():
                rank.setdefault(word, len(rank) + 1)
    return rank


def _class(c: str) -> tuple[int, int]:
    """A character's class and how many characters it has."""
    return (0, 10) if "0" <= c <= "9" else (1, 26) if "a" <= c <= "z" else (2, 26) if "A" <= c <= "Z" else (3, 33)


def _alphabet(piece: str) -> int:
    return max(sum(size for _, size in set(map(_class, piece))), 1)


class _Segments:
    """The segments of a value by their start; starts are asked for in rising order."""

    def __init__(self, value: str, rank: Mapping[str, int]):
        self.value, self.low, self.rank = value, value.lower(), rank
        self.plain = self.low.translate(LEET)
        self.until = [0] * 17  # for each period: up to where the value repeats itself at that distance

    def _repeated(self, i: int, size: int) -> int:
        """How many characters from i on equal the one `size` places after them."""
        value, j = self.value, max(self.until[size], i)
        while j + size < len(value) and value[j] == value[j + size]:
            j += 1
        self.until[size] = j
        return j - i

    def at(self, i: int, enough: float) -> Iterator[tuple[int, float]]:
        """(end, log10 guesses) of the segments that start at i and cost less than `enough`."""
        value, low, plain, n = self.value, self.low, self.plain, len(self.value)
        size, met = 0, set()
        for j in range(i + 1, n + 1):  # brute force over the span's own alphabet
            kind, more = _class(value[j - 1])
            if kind not in met:
                met.add(kind)
                size += more
            if (cost := (j - i) * math.log10(size)) >= enough:
                break
            yield j, cost
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = self.rank.get(low[i:j])
            extra = 0.0
            if rank is None and (rank := self.rank.get(plain[i:j])):
                extra = math.log10(2) * sum(a != b for a, b in zip(low[i:j], plain[i:j]))
            if rank:
                piece = value[i:j]
                case = 0.0 if piece.islower() else math.log10(2) if piece.isupper() or piece[1:].islower() else math.log10(2) * (j - i)
                yield j, math.log10(rank + 1) + extra + case
        if m := DATE.match(value, i):
            j = m.end()
            yield j, math.log10(200 * (365 if j - i > 4 else 1)) + (math.log10(4) if j - i > 8 else 0)
        end = i + self._repeated(i, 1) + 1
        # repeats of one character; one more of it is cheaper than any other segment, so but for the last places,
        # where what follows may begin, a cut needn't end within them
        for j in range(max(i + 3, end - 16), end + 1):
            yield j, math.log10(_alphabet(value[i]) * (j - i))
        for size in range(2, min(16, (n - i) // 2) + 1):  # repeats of a longer unit: the unit's brute force, once
            if value[i] == value[i + size] and (same := self._repeated(i, size)) >= size:
                times = same // size + 1
                yield i + size * times, size * math.log10(_alphabet(value[i : i + size])) + math.log10(times)
        for walk in (lambda a, b: (a, b) in _BESIDE, lambda a, b: ord(b) - ord(a) == 1, lambda a, b: ord(a) - ord(b) == 1):
            j, turns, step = i + 1, 0, 0  # keyboard walks, and runs of the alphabet or of digits
            while j < n and walk(low[j - 1], low[j]):
                before, step = step, ord(low[j]) - ord(low[j - 1])
                turns += before * step < 0
                j += 1
                if j - i >= 3:
                    if (cost := math.log10(47 * (j - i)) + math.log10(4) * (1 + turns)) >= enough:
                        break
                    yield j, cost


def guesses(value: str, enough: float = math.inf, rank: Mapping[str, int] = RANK) -> float:
    """log10 of the guesses of the cheapest cut, of any number of segments; 0 for an empty value.

    One programme over the whole value, forward from its start. The cost is
    exact if it is under `enough`, and `enough` otherwise: cuts are given up as
    soon as they reach it, so that a long random value ends after a few
    characters. A cut to a place is also given up if another one with no more
    segments is no dearer.
    """
    n = len(value)
    if not n:
        return 0.0
    segments = _Segments(value, rank)
    orders = [0.0]
    cuts: dict[int, dict[int, float]] = {0: {0: 0.0}}  # by place: the least cost for each number of segments
    for i in range(n):
        best = cuts.pop(i, None)
        if best is None:
            if not cuts:
                return enough
            continue
        open_, low = [], math.inf
        for c in sorted(best):
            if best[c] < low:
                low = best[c]
                open_.append((c + 1, low))
        while len(orders) <= open_[-1][0]:
            orders.append(orders[-1] + math.log10(len(orders)))
        for j, more in segments.at(i, enough):
            for c, cost in open_:
                if cost + more + orders[c] < enough:
                    row = cuts.setdefault(j, {})
                    if cost + more < row.get(c, math.inf):
                        row[c] = cost + more
    return min((cost + orders[c] for c, cost in cuts.get(n, {}).items()), default=enough)


def find(text: str, rank: Mapping[str, int] = RANK) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans) as (start, kind's number, end), each in order.

    Base spans are leftmost and non-overlapping within their kind. An added
    span is the whole value alone, up to white space. A value that begins in a
    base span isn't added; one that meets base spans later on is scored and
    added piece by piece between them.
    """
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = []
    at = reach = 0  # base spans before `at` begin before the value; `reach` is where the furthest of them ends
    for m in CONTEXT.finditer(text):
        a, b = m.span(1)
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if reach > a:
            continue
        while a < b:
            cut, on = (base[at][0], base[at][2]) if at < len(base) and base[at][0] < b else (b, b)
            end = a + len(text[a:cut].rstrip("\"'`,;:.)]}>"))
            if end - a >= 8 and guesses(text[a:end], LEAST, rank) >= LEAST:
                added.append((a, 3, end))
            a = max(a, on)
            while at < len(base) and base[at][0] <= a and a < b:
                a = max(a, base[at][2])
                reach = max(reach, base[at][2])
                at += 1
    return base, added


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, words: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) of every row of docs.

    `words` is the place of a byte-level tokenizer's vocabulary file, the same
    on every machine, that gives the dictionary (without it: the password
    words alone). Null text counts as empty: no spans. Very long texts and
    values are read whole; of cuts that tie any one gives the cost. A null id
    is kept; repeated rows give repeated rows; an empty table gives none; other
    columns aren't read, whatever their names.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = dictionary(words)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for x in batch.column(1):
                base, added = find(x.as_py() or "", rank)
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                row = (*n, len(added), hashlib.sha256(_line(base).encode()).hexdigest(), _line(sorted(base + added)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, type=t) for c, t in zip(out, types, strict=True))], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)
