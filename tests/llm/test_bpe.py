"""Forced boundaries: the library's own ids and texts, on odd strings and on the tables."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stancelake.llm import bpe
from stancelake.llm.queries import op11_bpe

FILES = {"word": "word_bpe_49k.json", "byte": "byte_bpe_50k.json"}
ODD = [
    "Hello World! it's <|endoftext|> x<|STARTOFTEXT|>y <|startoftext|>", "é́é ΑΣ ΑΣ. İstanbul ß 日本 🙂‍", "", "  ", "12 3a\x00b", "a<|endoftext|>", "ǅ ﬁ Å Ω a　b ́", "\x85\xa0\x1c x\x1fy",
    "qzqzqzxjxj" * 50, "don't I'LL we'Re ''s", "<|endoftext|><|endoftext|>", "x <|", "a" * 3000, "%&=" * 400, "﻿z�",
]


def library(kind, specials=True):
    t = Tokenizer.from_file(str(public_tokenizers.path(FILES[kind])))
    t.encode_special_tokens = not specials
    return t


def strings(seed, n):
    r = random.Random(seed)
    letters = "aA zZ09.,'!?<|>éÉßñ\t\n\r\x0b\x0c\x1c\x85\xa0µ ǅΣσςİ日🙂‍́ ½²ªñ"
    return ODD + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("specials", [True, False])
@pytest.mark.parametrize("kind", FILES)
def test_same_ids_and_texts_as_the_library(kind, specials, monkeypatch):
    path, t = str(public_tokenizers.path(FILES[kind])), library(kind, specials)
    own, speller = bpe.Cutter(path, kind, specials), bpe.Speller(path)
    texts = strings(1, 1500)
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    got = list(own.many(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [speller.text(g) for g in got] == [t.decode(w, skip_special_tokens=False) for w in want]
    monkeypatch.setattr(bpe, "LONG_TEXT", 30)  # long texts go in parts
    assert list(own.many(texts)) == got


@pytest.mark.parametrize("kind", FILES)
def test_cuts_stand_where_no_token_reaches(kind):
    own = bpe.Cutter(str(public_tokenizers.path(FILES[kind])), kind)
    words = [w.encode() for x in strings(2, 300) for w in x.split() if w]
    data, found = b"".join(words), own.fragments_of(words)
    assert b"".join(data[a:b] for a, b, _ in found) == data
    assert sum(f for _, _, f in found) == len(words) < len(found)
    assert own.encode_words(words) == [own.encode_words([w])[0] for w in words]


def test_rows(spark):
    path, t = str(public_tokenizers.path(FILES["word"])), library("word")
    rows = [(1, "Twice."), (1, "Twice."), (None, "No id"), (4, None), (5, ""), (6, "long word <|endoftext|> " * 40_000)]
    df = spark.createDataFrame([(*r, b"x", 3) for r in rows], "doc_id long, text string, ids binary, key int")
    out = bpe.digests(df, path).collect()

    def want(i, text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert sorted(map(str, map(tuple, out))) == sorted(str(want(*r)) for r in rows)
    assert bpe.digests(df.where("doc_id > 9"), path).count() == 0
    one, two = (sorted(map(str, map(tuple, x.collect()))) for x in (bpe.round_trip(df, path), bpe.decode(bpe.encode(df, path), path)))
    assert one == two
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), path).first().decoded == ""


def test_query_equals_the_library(spark, data):
    t = library("word")
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    out = op11_bpe(spark, data).collect()
    assert len(out) == len(docs)
    for r in out:
        ids = t.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
