"""Keyword search by an inverted index: compressed postings in blocks with their highest count, pruned by it.

Documents are dealt to shards of bounded size; in a shard they are numbered in
the order of their ids. A block holds up to BLOCK numbers of documents that
have a word, as differences, and how often each has it, both in as few bytes
as the largest takes. A search reads the blocks of its words alone, those that
may score most first, and stops where none left can reach its k-th hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from stancelake.commits import Transaction, bucket_of
from stancelake.tables import settle

SHARD, BLOCK = 50_000, 128
#: Questions that a search may be asked at once, which are broadcast.
QUESTIONS = 10_000
#: Parts that questions are dealt to: a block goes to each part that asks for its word, once, however many questions do.
SLICES = 8
POSTINGS = "shard int, word string, first long, last long, n int, most int, numbers binary, counts binary"


def lexemes(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _packed(x: np.ndarray) -> bytes:
    """A byte that says how wide the numbers are, and the numbers."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{raw[0]}", offset=1).astype(np.int64)


def numbered(docs: DataFrame, id_col: str, text: str = "text", shard: Column | None = None, size: int = SHARD) -> DataFrame:
    """(shard, number, id, text) of documents with an id: by a hash of the id, or as told; an id counts once, with its least text."""
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([shard.alias("shard")] if shard is not None else []))
    if shard is None:
        n = max(1, -(-d.count() // size))
        d = d.withColumn("shard", bucket_of(F.col("id"), n))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("id")).cast("long")
    numbers = d.select("shard", "id").distinct().select("shard", "id", place.alias("number"))  # a shard's ids meet in one task, its texts don't
    return d.groupBy("shard", "id").agg(F.min("text").alias("text")).join(numbers, ["shard", "id"]).select("shard", "number", "id", "text")


def postings(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The postings of numbered documents, in blocks; see POSTINGS."""
    words = docs.select("shard", "number", F.explode(lexemes(F.col("text"))).alias("word")).groupBy("shard", "word", "number").agg(F.count("*").alias("c"))
    lists = words.groupBy("shard", "word").agg(F.sort_array(F.collect_list(F.struct("number", "c"))).alias("l"))  # a shard's documents at most
    starts = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / block).cast("int"))
    blocks = lists.select("shard", "word", F.explode(F.transform(starts, lambda i: F.slice("l", i * block + 1, F.lit(block)))).alias("b"))
    rows = blocks.select("shard", "word", F.col("b.number").alias("numbers"), F.col("b.c").alias("counts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for numbers, counts in zip(batch.column("numbers"), batch.column("counts"), strict=True):
                x, c = numbers.values.to_numpy(), counts.values.to_numpy()
                for column, value in zip(out, (int(x[0]), int(x[-1]), len(x), int(c.max()), _packed(np.diff(x)), _packed(c)), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("word"), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["shard", "word", "first", "last", "n", "most", "numbers", "counts"])

    return rows.mapInArrow(pack, POSTINGS)


def _meet(blocks: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(numbers, scores, postings read) of the best k documents of one shard that hold all words."""
    words: dict[str, list[int]] = {}
    for i, w in enumerate(blocks.column("word").to_pylist()):
        words.setdefault(w, []).append(i)
    first, last, n, most = (blocks.column(c).to_numpy() for c in ("first", "last", "n", "most"))
    none = np.zeros(0, dtype=np.int64)
    if len(words) < blocks.column("need")[0].as_py():
        return none, none, 0
    lists = sorted((np.array(sorted(i, key=lambda j: first[j])) for i in words.values()), key=lambda i: n[i].sum())
    rare, others = lists[0], lists[1:]
    # which blocks of each other word overlap a block of the rarest one, and what may be scored there at most
    spans = [(np.searchsorted(last[o], first[rare]), np.searchsorted(first[o], last[rare], side="right")) for o in others]
    bound = most[rare].astype(np.int64)
    for o, (lo, hi) in zip(others, spans, strict=True):
        bound += [int(most[o[a:b]].max()) if a < b else -(1 << 60) for a, b in zip(lo, hi, strict=True)]
    opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    read = 0

    def held(i: int) -> tuple[np.ndarray, np.ndarray]:
        nonlocal read
        if i not in opened:
            read += int(n[i])
            opened[i] = first[i] + np.concatenate([[0], np.cumsum(_unpacked(blocks.column("numbers")[i].as_py()))]), _unpacked(blocks.column("counts")[i].as_py())
        return opened[i]

    numbers, scores = none, none
    for at in np.argsort(-bound, kind="stable"):
        if bound[at] < 0 or (len(scores) == k and bound[at] < scores[-1]):
            break
        x, c = held(int(rare[at]))
        for o, (lo, hi) in zip(others, spans, strict=True):
            parts = [held(int(i)) for i in o[lo[at] : hi[at]]]
            y, d = (np.concatenate([p[j] for p in parts]) for j in (0, 1))
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = y[place] == x
            x, c = x[both], c[both] + d[place[both]]
            if not len(x):
                break
        numbers, scores = np.concatenate([numbers, x]), np.concatenate([scores, c])
        top = np.lexsort((numbers, -scores))[:k]
        numbers, scores = numbers[top], scores[top]
    return numbers, scores, read


def search(index: DataFrame, names: DataFrame, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, rank, id, score), (query_id, read, held)): the k documents that hold all words of each question most often, and what postings that took.

    index and names(shard, number, id) are those of postings and numbered;
    questions(query_id, text) are at most QUESTIONS. A score is the sum of the
    words' counts; ties go to the lesser id; a question without words finds
    nothing.
    """
    asked = questions.select("query_id", F.array_distinct(lexemes(F.col("text"))).alias("words")).select("query_id", F.explode("words").alias("word"), F.size("words").alias("need"))
    if questions.limit(QUESTIONS + 1).count() > QUESTIONS:
        raise ValueError(f"more than {QUESTIONS} questions at once")
    kind = questions.schema["query_id"].dataType.simpleString()
    part = F.pmod(F.xxhash64("query_id"), F.lit(SLICES)).cast("int")
    asked = asked.withColumn("part", part)
    questions_of: dict[int, dict] = {}
    for r in asked.collect():  # the words of QUESTIONS questions at most
        questions_of.setdefault(r.part, {}).setdefault(r.query_id, []).append(r.word)
    words = F.broadcast(asked.select("part", "word").distinct())
    hit = index.join(words, "word").select("part", "shard", "word", "first", "last", "n", "most", "numbers", "counts")

    def meet(key: tuple, blocks: pa.Table) -> pa.Table:
        rows: dict[str, list[int]] = {}
        for i, w in enumerate(blocks.column("word").to_pylist()):
            rows.setdefault(w, []).append(i)
        out: list[list] = [[] for _ in range(5)]
        for q, ws in questions_of[key[0].as_py()].items():
            own = [i for w in ws for i in rows.get(w, ())]
            if own:
                some = blocks.take(pa.array(own))
                numbers, scores, read = _meet(some.append_column("need", pa.repeat(len(ws), len(own))), k)
                more = [0] * len(numbers)
                for column, values in zip(out, ([q] * (len(more) + 1), [None, *numbers.tolist()], [None, *scores.tolist()], [read, *more], [int(some.column("n").to_numpy().sum()), *more]), strict=True):
                    column += values
        ids, *rest = out
        return pa.table({"query_id": pa.array(ids, id_type), "shard": pa.repeat(key[1], len(ids)), **{c: pa.array(v, pa.int64()) for c, v in zip(("number", "score", "read", "held"), rest, strict=True)}})

    id_type = to_arrow_type(questions.schema["query_id"].dataType)
    met = hit.groupBy("part", "shard").applyInArrow(meet, f"query_id {kind}, shard int, number long, score long, read long, held long")
    met = settle(met, "search")
    found = met.where("number is not null").join(names.select("shard", "number", "id"), ["shard", "number"])
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
    return ranked, met.groupBy("query_id").agg(F.sum("read").alias("read"), F.sum("held").alias("held"))


def store(t: Transaction, name: str, rows: DataFrame, key: str, id_col: str, text: str) -> None:
    """Replace keys of a stored table and, in the same commit, the index of the buckets that they lie in.

    The index is two tables, name_postings and name_names, whose shards are
    the table's buckets; so what is replaced is indexed anew, and nothing else.
    """
    t.replace(name, rows, key)
    buckets = sorted(t.rewritten[name])
    n = t._table(name)["buckets"]
    docs = numbered(t._frame(name, buckets), id_col, text, shard=bucket_of(F.col(key), n))
    gone = docs.sparkSession.createDataFrame([(int(b),) for b in buckets], "shard int")
    docs = settle(docs, "numbered")
    for table, new in ((f"{name}_postings", postings(docs)), (f"{name}_names", docs.select("shard", "number", "id"))):
        if t._table(table) is not None:
            t.remove(table, gone)
        t.append(table, new, "shard")
        if t.needs.get(table) is not None:
            t.needs[table] |= set(map(str, range(n)))  # two writers of one shard may not both add to it
