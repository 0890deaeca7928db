"""Whole-text token ids from the tokenizers library, with a memo of pieces.

Both vocabularies split a text into pieces first and merge inside a piece
only, so the ids of a text are those of its pieces, one after another. Texts
whose characters all lie below U+0100 are cut here by the same rule, written
out for those characters, and each distinct piece goes through the library
once; any other text goes through the library whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
SPLITS = {
    "byte": re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"),
    "word": re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"),
}
MEMO_ENTRIES = 400_000
LONG_TEXT, PIECES_AT_ONCE, PIECES_WAITING = 2_000_000, 500_000, 40_000

_encoders: dict[tuple[str, str], "Encoder"] = {}


def encoder(path: str, kind: str) -> "Encoder":
    """One for each worker process, vocabulary file and kind ('byte' or 'word')."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


class Encoder:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.lower = kind == "word"
        self.split = SPLITS[kind]
        self.memo: dict[str, bytes] = {}
        # for pieces that are cut already: the same vocabulary and merges, without the cutting
        self.pieces = Tokenizer.from_file(path)
        self.pieces.encode_special_tokens = True
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of text that an id stands for
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>") if self.lower else token)

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        ids = np.asarray(self.pieces.encode_batch_fast([pieces], add_special_tokens=False, is_pretokenized=True)[0].ids, dtype="<u4")
        ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in pieces), dtype=np.int64, count=len(pieces)))
        cuts = (4 * (np.searchsorted(np.cumsum(self.width[ids]), ends) + 1)).tolist()
        raw = ids.tobytes()
        return {p: raw[a:b] for p, a, b in zip(pieces, [0, *cuts], cuts, strict=False)}

    def _found(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; new pieces are encoded in one call."""
        memo = self.memo
        got = list(map(memo.get, pieces))
        missing, i = [], -1
        try:
            while True:
                i = got.index(None, i + 1)
                missing.append(i)
        except ValueError:
            pass
        if missing:
            own = self._new(list({pieces[i]: None for i in missing}))
            for i in missing:
                got[i] = own[pieces[i]]
            if len(memo) < MEMO_ENTRIES:  # frequent pieces come early, so a full memo is kept as it is
                memo.update(own)
        return got

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def many(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of every text, as little-endian unsigned 32-bit integers, in order."""
        pieces: list[str] = []
        ends: list[int] = []  # of each text that waits; -1 - k: the k-th of `whole`
        whole: list[bytes] = []

        def out() -> Iterator[bytes]:
            got, at = self._found(pieces), 0
            for end in ends:
                if end < 0:
                    yield whole[-1 - end]
                else:
                    yield b"".join(got[at:end])
                    at = end
            pieces.clear()
            ends.clear()
            whole.clear()

        for text in texts:
            if not text.isascii():
                try:
                    text.encode("latin-1")
                except UnicodeEncodeError:
                    ends.append(-1 - len(whole))
                    whole.append(self._whole(text))
                    continue
            if self.lower:
                text = text.lower()
            if len(text) < LONG_TEXT:
                pieces += self.split.findall(text)
                ends.append(len(pieces))
            else:  # piece by piece, so that a very long text is never all in pieces at once
                found = (m[0] for m in self.split.finditer(text))
                parts = []
                while chunk := list(islice(found, PIECES_AT_ONCE)):
                    parts.append(b"".join(self._found(chunk)))
                ends.append(-1 - len(whole))
                whole.append(b"".join(parts))
            if len(pieces) >= PIECES_WAITING:
                yield from out()
        yield from out()

    def ids(self, text: str) -> bytes:
        return next(iter(self.many([text])))


END = np.asarray([1], dtype="<u4").tobytes()


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
