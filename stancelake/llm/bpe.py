"""Token ids by forced boundaries, and texts from ids, as the tokenizers library gives them.

A merge makes a token, so two bytes that stand side by side in no token of the
vocabulary are never merged: between them a cut is certain. Words are cut
there, each distinct fragment is encoded once by itself, and a word's ids are
those of its fragments, one after another. Fragments at a word's end carry the
vocabulary's mark of word ends, if it has one; others don't.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancelake.llm.encode import LONG_TEXT, MEMO_ENTRIES, PIECES_AT_ONCE, SPLITS

#: Words that wait for their ids, bytes of ids or text in a batch of rows, fragments that are remembered.
WAITING, BATCH, FRAGMENTS = 40_000, 4 << 20, 100_000
#: Where a text may be cut beforehand: no rule of either vocabulary looks past a blank before one of these.
_SAFE = re.compile(r" (?=[A-Za-z0-9])")

_cutters: dict[tuple[str, str, bool], "Cutter"] = {}


def cutter(path: str, kind: str, specials: bool) -> "Cutter":
    """One for each worker process and vocabulary."""
    if (path, kind, specials) not in _cutters:
        _cutters[path, kind, specials] = Cutter(path, kind, specials)
    return _cutters[path, kind, specials]


def alphabet() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printing ones stand for themselves, others for what follows U+0100, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


LETTERS = alphabet()
_BYTES = {ord(c): b for b, c in enumerate(LETTERS)}
_SPELT = dict(enumerate(LETTERS))


class Cutter:
    """specials: whether the strings of special tokens in a text become those tokens (the library's default) or ordinary text."""

    def __init__(self, path: str, kind: str, specials: bool = True):
        from tokenizers import Tokenizer, models

        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())
        model = spec["model"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that aren't matched as they stand are not supported")
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        del whole
        self.lower, self.split = kind == "word", SPLITS[kind]
        own = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.special = {t: np.asarray([i], dtype="<u4").tobytes() for t, i in own.items()}
        self.special_at = re.compile("(" + "|".join(map(re.escape, own)) + ")") if own else None
        self.mark = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.inner = Tokenizer(models.BPE(vocabulary, merges))
        self.final = Tokenizer(models.BPE(vocabulary, merges, end_of_word_suffix=self.mark)) if self.mark else self.inner
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        #: [whether the second byte ends a word][first byte, second byte]: whether some token holds the two side by side there.
        self.joined = np.zeros((2, 256, 256), dtype=bool)
        for token, i in vocabulary.items():
            ends = bool(self.mark) and token.endswith(self.mark)
            raw = [_BYTES[ord(c)] for c in (token[: -len(self.mark)] if ends else token)]
            self.width[i] = len(raw)
            for k in range(len(raw) - 1):
                self.joined[int(ends and k == len(raw) - 2), raw[k], raw[k + 1]] = True
        if not self.mark:
            self.joined[1] = self.joined[0]
        self.words: dict[str, bytes] = {}
        self.fragments: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # by the vocabulary's letters; those at a word's end are the second

    def fragments_of(self, words: list[bytes]) -> list[tuple[int, int, bool]]:
        """(start, end, whether a word ends there) of each fragment, counted through all of the words."""
        ends = np.cumsum([len(w) for w in words])
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        last = np.zeros(len(data), dtype=bool)
        last[ends - 1] = True
        cut = last.copy()
        cut[:-1] |= ~self.joined[last[1:].astype(np.int8), data[:-1], data[1:]]
        stops = np.flatnonzero(cut) + 1
        return list(zip([0, *stops[:-1].tolist()], stops.tolist(), last[stops - 1].tolist(), strict=True))

    def _encode(self, fragments: list[str], final: bool) -> list[bytes]:
        ids = np.asarray((self.final if final else self.inner).encode_batch_fast([fragments], add_special_tokens=False, is_pretokenized=True)[0].ids, dtype="<u4")
        stops = (4 * (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(f) for f in fragments])) + 1)).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, none of them empty, by their fragments."""
        found = self.fragments_of(words)
        spelt = b"".join(words).decode("latin-1").translate(_SPELT)  # one letter a byte
        named = [(spelt[a:b], final) for a, b, final in found]
        for final, memo in enumerate(self.fragments):
            fresh = list({f: None for f, last in named if last == bool(final) and f not in memo})
            if fresh:
                if len(memo) > FRAGMENTS:
                    memo.clear()
                    fresh = list({f: None for f, last in named if last == bool(final)})
                memo.update(zip(fresh, self._encode(fresh, bool(final)), strict=True))
        inner, whole = self.fragments
        out, parts = [], []
        for f, final in named:
            if not final:
                parts.append(inner[f])
            elif parts:
                out.append(b"".join([*parts, whole[f]]))
                parts = []
            else:
                out.append(whole[f])
        return out

    def _ids(self, words: list[str], raw: bool) -> list[bytes]:
        """The ids of words as they are spelt in the text (raw), or in the vocabulary's letters."""
        memo = self.words
        keys = words if raw else ["\0" + w for w in words]
        got = list(map(memo.get, keys))
        missing = [i for i, x in enumerate(got) if x is None] if None in got else []
        if missing:
            fresh = list({keys[i]: None for i in missing})
            own = dict(zip(fresh, self.encode_words([k.encode() if raw else bytes(map(_BYTES.__getitem__, map(ord, k[1:]))) for k in fresh]), strict=True))
            for i in missing:
                got[i] = own[keys[i]]
            if len(memo) < MEMO_ENTRIES:  # frequent words come early, so a full memo is kept as it is
                memo.update(own)
        return got

    def _sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """(part of the text, whether it is a special token), long parts in several."""
        for i, part in enumerate(self.special_at.split(text) if self.special_at and "<|" in text else [text]):
            at = 0
            while len(part) - at > LONG_TEXT and (m := _SAFE.search(part, at + LONG_TEXT)):
                yield part[at : m.start()], False
                at = m.start()
            yield part[at:], bool(i % 2)

    def ids(self, text: str) -> bytes:
        return next(iter(self.many([text])))

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers, in order."""
        words: list[str] = []
        ends: list[int] = []  # of each text that waits; -1 - k: the k-th of `whole`
        whole: list[bytes] = []

        def out() -> Iterator[bytes]:
            got, at = self._ids(words, True) if words else [], 0
            for end in ends:
                yield whole[-1 - end] if end < 0 else b"".join(got[at:end])
                at = max(at, end)
            words.clear()
            ends.clear()
            whole.clear()

        for text in texts:
            if len(text) < LONG_TEXT and _plain(text) and not (self.special_at and "<|" in text):
                words += self.split.findall(text.lower() if self.lower else text)
                ends.append(len(words))
            else:
                parts = []
                for part, special in self._sections(text):
                    if special:
                        parts.append(self.special[part])
                    elif _plain(part):
                        found = (m[0] for m in self.split.finditer(part.lower() if self.lower else part))
                        while chunk := list(islice(found, PIECES_AT_ONCE)):
                            parts += self._ids(chunk, True)
                    elif part:
                        cut = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part) if self.normalizer else part)
                        parts += self._ids([w for w, _ in cut], False) if cut else []
                ends.append(-1 - len(whole))
                whole.append(b"".join(parts))
            if len(words) >= WAITING:
                yield from out()
        yield from out()


def _plain(text: str) -> bool:
    """Whether all characters lie below U+0100, for which the split is written out."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Speller:
    """Texts from ids: tokens with a blank between them, or their bytes where the vocabulary's decoder is one of bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())
        kind = (spec["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"a decoder of kind {kind} is not supported")
        self.blank = b"" if kind else b" "
        tokens = whole.get_vocab(with_added_tokens=True)
        self.tokens = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.tokens[i] = bytes(map(_BYTES.__getitem__, map(ord, token))) if kind else token.encode()

    def text(self, ids: bytes) -> str:
        return self.blank.join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


def _sliced(rows: Iterable[tuple], schema: pa.Schema, most: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of rows whose last value is sized, of about `most` bytes."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, path: str, kind: str = "word", specials: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): each text's ids, little-endian unsigned 32-bit integers in one binary value.

    kind: 'word' or 'byte', the rule by which the vocabulary cuts words. Null
    and empty texts, and those of white space alone, have no ids, where the
    rule drops it; long texts are encoded whole, part by part; rows with null
    or repeated keys stay, each by itself; an empty table gives no rows; other
    columns are not looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    field = docs.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cutter(path, kind, specials)
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), pa.field("ids", pa.binary())])
            yield from _sliced(zip(batch.column(0).to_pylist(), own.many(x.as_py() for x in batch.column(1)), strict=True), schema)

    return rows.mapInArrow(run, f"key {field.dataType.simpleString()}, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the text that the ids stand for, special tokens too; null ids give an empty text."""
    field = rows.schema[key]
    rows = rows.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(path)
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), pa.field("ids", pa.binary()), pa.field("decoded", pa.string())])
            yield from _sliced(((k, i, speller.text(i)) for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), schema)

    return rows.mapInArrow(run, f"key {field.dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, kind: str = "word", specials: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): encode and decode in one pass, by one worker a task; rows as in both."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, speller = cutter(path, kind, specials), Speller(path)
        for batch in batches:
            schema = pa.schema([pa.field("key", batch.schema.field(0).type), pa.field("ids", pa.binary()), pa.field("decoded", pa.string())])
            ids = own.many(x.as_py() for x in batch.column(1))
            yield from _sliced(((k.as_py(), i, speller.text(i)) for k, i in zip(batch.column(0), ids, strict=True)), schema)

    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, kind: str = "word") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of texts encoded and decoded again."""
    return round_trip(docs, path, kind).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
