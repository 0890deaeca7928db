"""Collocations: phrases of two to four words that occur often, by language, scored by how rarely their parts occur apart.

Texts are dealt to shards of words and gaps between pieces. In a shard every
word has a bitmap of its places, of which only cells that aren't empty are
held; a phrase's bitmap, shifted by one and ANDed with the words' in the same
cells, gives those of the longer phrases, and population counts are their
counts there. A gap is a place without a word, so no phrase gets past it. A
slice of phrases is extended to its full depth before the next one, and Spark
sums the counts of all shards.

A phrase is no more frequent than its parts, so pairs are looked for among
frequent words alone, and longer phrases where every two neighbours are a
frequent pair. Which pairs are is told by sums over their hashes, so that the
many rare ones are shuffled as numbers. Shards learn both from a bit filter
whose size has a fixed bound: it lets too much through at worst, and only sums
over all shards decide.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stancelake.llm.common import settle

PIECE, GAP = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Least count, words of the longest phrase, share in percent at which a longer phrase absorbs a shorter one, phrases of a language.
LEAST, LONGEST, ABSORBS, TOP = 30, 4, 80, 2000
#: Bytes of text of a shard, shards that a Python worker is handed at once, most bits of a filter.
SHARD, BATCH, FILTER = 1 << 20, 4, 1 << 28
#: Bits of a pair's hash. Pairs that share them count together, so too many may be looked at, but no frequent one is missed.
PAIR_BITS = 40
#: Shares of a language's phrases that are ranked by themselves first, so that its last ranking has no more than DEALT times the places.
DEALT = 64
SHARDS = "lang string, words array<string>, counts array<int>, ids binary, spare int"

_KIND = np.zeros(256, dtype=np.uint8)  # 0: in a word
_KIND[list(GAP)] = 1
_KIND[list(PIECE)] = 2
_END = re.compile(rb"[ \t.,;:!?\n-\r]")
_NEXT = re.compile(rb"[ \t]*([^ \t.,;:!?\n-\r]+)")


def parts(text: bytes, most: int = SHARD, longest: int = LONGEST) -> Iterator[tuple[bytes, int]]:
    """(part, spare): a long text in parts, cut between pieces, or between words where a piece is too long itself.

    In the second case the next words come once more at the part's end, so
    that phrases reach over the cut: `spare` words that begin no phrase there.
    """
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(bytes([d]), at, at + most) for d in PIECE)
        if cut < 0:
            cut = max(text.rfind(bytes([d]), at, at + most) for d in GAP)
        if cut < 0:  # one word is longer than that
            end = _END.search(text, at + most)
            if end is None:
                break
            cut = end.start()
        again, after = [], cut
        if text[cut] in GAP:
            while len(again) < longest - 1 and (m := _NEXT.match(text, after)):
                again.append(m[1])
                after = m.end()
        yield b" ".join([text[at:cut], *again]), len(again)
        at = cut + 1
    yield text[at:], 0


def _shard(texts: list[bytes], spare: int) -> tuple | None:
    """(distinct words, their counts, a word's number at every position or -1 in a gap, spare) of some texts."""
    data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    kind = _KIND[data]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return None
    letters = data[inside]
    letters = letters + (((letters >= 65) & (letters <= 90)).astype(np.uint8) << 5)
    ends = np.concatenate([[0], np.cumsum(last - first)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(letters)).dictionary_encode()
    number = words.indices.to_numpy()
    piece = np.cumsum(kind == 2, dtype=np.int32)[first]
    at = np.arange(len(first)) + np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    ids = np.full(at[-1] + 1, -1, dtype=np.int32)
    ids[at] = number
    return words.dictionary, np.bincount(number[: len(number) - spare], minlength=len(words.dictionary)).astype(np.int32), ids, spare


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SHARD, longest: int = LONGEST) -> DataFrame:
    """Texts of one language together, up to about `size` bytes of them in a row."""

    def rows(found: list[tuple[str, tuple]]) -> Iterator[pa.RecordBatch]:
        for key, (words, counts, ids, spare) in found:
            one = pa.array([0, len(words)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(counts)), pa.array([ids.tobytes()], pa.binary()), pa.array([spare], pa.int32())], names=["lang", "words", "counts", "ids", "spare"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            yield from rows([(k, s) for k, t in held.items() if (s := _shard(t, 0))])
            held.clear()

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                raw = value.as_py()
                if len(raw) > size:
                    for part, spare in parts(raw, size, longest):
                        yield from rows([(key, s)] if (s := _shard([part], spare)) else [])
                    continue
                held.setdefault(key, []).append(raw)
                waiting += len(raw)
                if waiting > size:
                    yield from out()
                    waiting = 0
        yield from out()

    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull()).mapInArrow(run, SHARDS)


# --- filters ---------------------------------------------------------------------------------------


def _filter(hashes: DataFrame) -> np.ndarray:
    """Two bits for each value of hashes(h), in 64-bit cells; 16 bits a value or more up to FILTER bits in all, which bounds what the driver gets."""
    bits = min(FILTER, 1 << max(16, (16 * hashes.count()).bit_length()))
    two = F.array(F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1))
    cells = hashes.select(F.explode(two).alias("b")).select(F.shiftright("b", 6).alias("cell"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    got = cells.toArrow()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _in(cells: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    h = hashes.view(np.uint64)
    mask = np.uint64(64 * len(cells) - 1)
    held = np.ones(len(h), dtype=bool)
    for b in (h & mask, (h >> np.uint64(32)) & mask):
        held &= (cells[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)
    return held


def _word_hash(lang: Column | str, word: Column) -> Column:
    return F.xxhash64(lang, word)


def _hash(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h: np.ndarray = np.full(len(columns[0]), 42, dtype=np.uint64)
    for c in columns:
        h = h + p5 + np.uint64(8)
        h = turn(h ^ (turn(c.view(np.uint64) * p2, 31) * p1), 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h.view(np.int64)


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A short number for a pair of hashed words, as it is shuffled: PAIR_BITS of its hash."""
    return _hash(one, two) & ((1 << PAIR_BITS) - 1)


# --- bitmaps ---------------------------------------------------------------------------------------

#: Places of a cell, and cells that are extended at once.
CELL, CELLS = 8, 1 << 15
_ONES = np.array([bin(x).count("1") for x in range(256)], dtype=np.int64)

#: Compressed bitmaps of many words or phrases: (whose, which cell, its bits) of every cell that isn't empty.
Bitmaps = tuple[np.ndarray, np.ndarray, np.ndarray]


def bitmaps(ids: np.ndarray) -> Bitmaps:
    """Where each word stands, by word and cell; -1 is a gap."""
    at = np.flatnonzero(ids >= 0)
    cells = len(ids) // CELL + 1
    key = ids[at].astype(np.int64) * cells + at // CELL
    order = np.argsort(key, kind="stable")
    key, bits = key[order], (1 << (at[order] % CELL)).astype(np.uint8)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // cells, key[first] % cells, np.bitwise_or.reduceat(bits, first) if len(first) else bits


def shifted(maps: Bitmaps) -> Bitmaps:
    """Every bitmap moved on by one place; a cell may come twice, with other bits."""
    whose, cell, bits = maps
    up, carry = bits << np.uint8(1), bits >> np.uint8(CELL - 1)
    stays, moves = up > 0, carry > 0
    return np.concatenate([whose[stays], whose[moves]]), np.concatenate([cell[stays], cell[moves] + 1]), np.concatenate([up[stays], carry[moves]])


def count(ids: np.ndarray, shortest: int, longest: int, joined: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, spare: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrases, their counts): those of `shortest` to `longest` words in a row of word numbers, a column of numbers each.

    joined says of pairs of words whether they may be neighbours in a phrase.
    Words in the last `spare` places begin none. A phrase may come in several
    parts, whose counts add up.
    """
    words = bitmaps(ids)
    order = np.argsort(words[1], kind="stable")
    word, cell_of, bits_of = (x[order] for x in words)
    begins = np.searchsorted(cell_of, np.arange(len(ids) // CELL + 3))
    several = int(ids.max(initial=0)) + 1

    def extend(phrases: np.ndarray, maps: Bitmaps) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """phrases, whose ends maps hold, by every word that follows."""
        for lo in range(0, len(maps[0]), CELLS):
            whose, cell, bits = shifted(tuple(x[lo : lo + CELLS] for x in maps))
            here = begins[cell + 1] - begins[cell]  # words in the cell
            one = np.repeat(np.arange(len(whose)), here)
            other = np.arange(len(one)) + np.repeat(begins[cell] - (np.cumsum(here) - here), here)
            both = bits[one] & bits_of[other]
            hit = np.flatnonzero(both)
            one, both = one[hit], both[hit]
            found, which = np.unique(whose[one] * several + word[other[hit]], return_inverse=True)
            longer = np.vstack([phrases[:, found // several], found % several])
            if joined is not None:
                may = joined(longer[-2], longer[-1])
                kept = may[which]
                one, both, which = one[kept], both[kept], (np.cumsum(may) - 1)[which[kept]]
                longer = longer[:, may]
            if not longer.shape[1]:
                continue
            if len(longer) >= shortest:
                yield longer, np.bincount(which, weights=_ONES[both], minlength=longer.shape[1]).astype(np.int64)
            if len(longer) < longest:
                order = np.argsort(which, kind="stable")
                yield from extend(longer, (which[order], cell[one[order]], both[order]))

    yield from extend(np.arange(several)[None, :], bitmaps(ids[: len(ids) - spare]))


@contextmanager
def _few_rows(spark: SparkSession, n: int = BATCH) -> Iterator[None]:
    """Shards are large rows, so a batch of them for Python holds few."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def _shards_of(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[tuple[pa.Scalar, pa.Array, np.ndarray, np.ndarray, int]]:
    """(language, spelling, hashes, numbers, spare) of each shard, words that the filter lets go as gaps."""
    for batch in batches:
        for i in range(batch.num_rows):
            hashes, ids = batch.column("hashes")[i].values.to_numpy(), np.frombuffer(batch.column("ids")[i].as_py(), dtype=np.int32)
            known = np.append(_in(words, hashes), False)  # the last one is the gap's
            pa.default_memory_pool().release_unused()  # of the shard before
            yield batch.column("lang")[i], batch.column("words")[i].values, hashes, np.where(known[ids], ids, -1), batch.column("spare")[i].as_py()


def _hashed(held: DataFrame) -> DataFrame:
    return held.select("lang", "words", F.transform("words", lambda w: _word_hash("lang", w)).alias("hashes"), "ids", "spare")


def _pair_hashes(held: DataFrame, words: np.ndarray) -> DataFrame:
    """(h, n): how often the pairs of words with this hash occur in all shards; of equal hashes the counts add up, so no frequent pair is missed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, hashes, ids, spare in _shards_of(batches, words):
            for pairs, n in count(ids, 2, 2, None, spare):
                yield pa.RecordBatch.from_arrays([pa.array(_pair(hashes[pairs[0]], hashes[pairs[1]])), pa.array(n)], names=["h", "n"])

    return _hashed(held).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _counted(held: DataFrame, longest: int, words: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """(lang, phrase, n): the sums over shards of what `count` finds among words and pairs that pass the filters, from two words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, spelt, hashes, ids, spare in _shards_of(batches, words):
            joined = lambda a, b, h=hashes: _in(pairs, _hash(_pair(h[a], h[b])))
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            both = both[joined(ids[both], ids[both + 1])]
            linked = np.zeros(len(ids), dtype=bool)
            linked[both] = linked[both + 1] = True
            for phrases, n in count(np.where(linked, ids, -1), 2, longest, joined, spare):
                phrase = pc.binary_join_element_wise(*[spelt.take(pa.array(c)) for c in phrases], " ")
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, lang, "\t"), pa.array(n)], names=["key", "n"])

    return _summed(_hashed(held).mapInArrow(run, "key string, n long"))


def _summed(rows: DataFrame) -> DataFrame:
    """(lang, phrase, n) of (key, n), where a key is phrase, tab, language: one string is shuffled in place of two, and no word holds a tab."""
    key = F.split("key", "\t", 2)
    return rows.groupBy("key").agg(F.sum("n").alias("n")).select(key[1].alias("lang"), key[0].alias("phrase"), "n")


# --- phrases ---------------------------------------------------------------------------------------


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, n): every phrase of one to `longest` words with n >= least, (lang, n): all words of a language)."""
    held = settle(shards(docs, size=size, longest=longest), "phrase-shards")
    totals = held.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    single = _summed(held.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.concat("w.words", F.lit("\t"), "lang").alias("key"), F.col("w.counts").alias("n")))
    ones = settle(single.where(F.col("n") >= least), "phrase-words")
    words = _filter(ones.select(_word_hash("lang", F.col("phrase")).alias("h")))
    with _few_rows(docs.sparkSession):
        hashes = settle(_pair_hashes(held, words).where(F.col("n") >= least).select(F.xxhash64("h").alias("h")), "phrase-hashes")
        found = ones.union(settle(_counted(held, longest, words, _filter(hashes)).where(F.col("n") >= least), "phrase-longer"))
    return found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "n"), totals


def _spelt(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbs: int = ABSORBS, top: int = TOP, size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    a is the phrase's count, l and r those of the two parts at the cut that
    scores least (ties: the first cut), n the count of all words, score
    floor(2,000,000 a / (l + r)). A phrase goes if a longer candidate that
    holds it has `absorbs` percent of its count. Ties of score and count are
    in the order of the phrase's bytes.

    Letters A to Z are lower-cased; words are split at spaces and tabs, pieces
    at . , ; : ! ? and line ends. Null and empty texts hold no words, texts of
    any length count whole, equal rows count each, a null language is `und`,
    an empty table gives no rows, and other columns are not looked at.
    """
    found, totals = frequent(docs, least, longest, size)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    several = found.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("n").alias("a"))
    cuts = several.select("lang", "phrase", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _spelt(F.col("w"), F.lit(1), F.col("k")).alias("first"), _spelt(F.col("w"), F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    of = lambda part, n: found.select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    score = (F.lit(2_000_000).cast("decimal(8,0)") * wide("a")).alias("x"), (wide("l") + wide("r")).alias("y")
    cuts = cuts.select("*", *score).withColumn("score", F.expr("x div y"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = several.where(F.size("w") > 2).select("lang", "w", "a", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("m"))
    inner = inner.select("lang", "w", "a", "m", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", _spelt(F.col("w"), F.col("i"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < absorbs * wide("a")))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # first places among a share of a language's phrases, then among those that have one
    dealt = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(dealt)).where(F.col("rank") <= top)
    by = Window.partitionBy("lang").orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


#: The same, for DuckDB.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), spelt AS (
  SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT id, lang, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM spelt
), totals AS (
  SELECT lang, count(*) AS n FROM placed GROUP BY lang
), four AS (
  SELECT lang, w AS w1, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3, lead(w, 3) OVER p AS w4 FROM placed WINDOW p AS (PARTITION BY id ORDER BY i)
), f AS (
  SELECT lang, w1 AS g, 1 AS m, count(*) AS a FROM four GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, concat_ws(' ', w1, w2), 2, count(*) FROM four WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), 3, count(*) FROM four WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3, w4), 4, count(*) FROM four WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), several AS (
  SELECT lang, g, m, a, string_split(g, ' ') AS w FROM f WHERE m > 1
), cut AS (
  SELECT lang, g, a, k, array_to_string(w[1 : k], ' ') AS g1, array_to_string(w[k + 1 : m], ' ') AS g2 FROM several, (VALUES (1), (2), (3)) AS t(k) WHERE k < m
), scored AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, ((2000000::HUGEINT * c.a) // (x.a + y.a))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.g = c.g1 JOIN f y ON y.lang = c.lang AND y.g = c.g2
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), part AS (
  SELECT s.lang, array_to_string(s.w[i : i + t.m - 1], ' ') AS g, s.a FROM several s, (VALUES (2), (3)) AS t(m), (VALUES (1), (2), (3)) AS u(i) WHERE s.m > t.m AND i + t.m - 1 <= s.m
), inside AS (
  SELECT lang, g, max(a) AS longer FROM part GROUP BY lang, g
), kept AS (
  SELECT b.lang, b.g AS phrase, b.a, l, r, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.g = b.g
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * b.a
)
SELECT k.lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k JOIN totals t ON t.lang = k.lang WHERE rank <= 2000
"""
