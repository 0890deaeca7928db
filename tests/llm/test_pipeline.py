"""The pipeline's stages in order, and its last rows against a round trip."""

import random

import numpy as np
import zlib

import corpus_pipeline as cp
from pyspark.sql import functions as F

from stancelake.llm import near_copies as copies

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = cp.settle(docs, f"test-{name}")
        seen[name] = docs
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    clean, junk = marks.where("quality = 1 and toxic = 0"), marks.where("quality = 0")
    n = lambda df, m: df.join(m, "doc_id", "left_semi").count()
    assert n(seen["quality"], clean) >= 0.99 * clean.count() and n(seen["quality"], junk) <= 0.03 * junk.count()
    assert seen["near_dedup"].count() == seen["near_dedup"].select("doc_id").distinct().count()
    assert seen["redact"].count() == seen["near_dedup"].count()
    assert seen["redact"].where(F.col("text").rlike(r"@mail[0-9]\.example")).count() == 0
    assert seen["redact"].where("n_chars <> length(text)").count() == 0
    left = n(seen["redact"], clean)
    assert n(seen["mix"], clean) >= 0.95 * left
    rows = cp.STAGES[-1][1](spark, docs, SF).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(cp.vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for r in docs.where("length(text) < 2000").orderBy("doc_id").limit(20).collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
        own = sorted((x.start, x.length, x.ids_crc32) for x in rows if x.doc_id == r.doc_id)
        assert sum(x[1] for x in own) == len(ids)
        for start, length, crc in own:
            assert crc == zlib.crc32(np.asarray(ids[start : start + length], dtype="<u4").tobytes())


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and an empty table: columns stay, nothing crashes."""
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "s", 0),
        (None, "no id but some words to keep here", "en", None, 33),
        (3, "mail me at a.b@example.com please, thank you very much indeed", None, "s", None),
        (3, "mail me at a.b@example.com please, thank you very much indeed", None, "s", None),
        (4, "long words in a row. " * 20_000, "en", "s", 420_000),
        (5, "A short and sound sentence stands here. Another one follows it.", "en", "s", 62),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("x"), "fp": F.lit(1), "rate": F.lit(2.0)})
    small = "/root/testdata/sf0.001"
    for df in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, df, small)
            assert out.columns == df.columns and out.count() <= df.count(), name
        rows = cp.STAGES[-1][1](spark, df, small).collect()
        assert sum(r.start == 0 for r in rows) == df.count()
    kept = cp.redact(spark, docs, small)
    assert kept.where("doc_id = 3").first().text == "mail me at [EMAIL] please, thank you very much indeed"
    assert kept.where("doc_id = 3").count() == 2 and kept.where("doc_id = 1").first().text is None


def planted_copies(seed=7, groups=150, big=200):
    """(rows, groups of ids): texts with copies of which single words are changed, and one large group."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    rows, planted = [], []
    for g in range(groups):
        base = [word() for _ in range(rnd.randint(100, 300))]
        ids = []
        for _ in range(big if g == 0 else 3):
            text = base[:]
            if ids:  # each changed word changes five shingles
                for _ in range(max(1, len(base) // 120)):
                    text[rnd.randrange(len(text))] = word()
            ids.append(len(rows))
            rows.append((len(rows), " ".join(text)))
        planted.append(ids)
    return rows, planted


def test_near_dedup_finds_near_copies(spark):
    rows, planted = planted_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()}
    sets = [copies.shingles(t.encode()) for _, t in rows]
    near = [(g[0], i) for g in planted for i in g[1:] if copies.jaccard(sets[g[0]], sets[i]) >= 0.8]
    assert len(near) > 400
    assert sum(i in left for _, i in near) <= 0.01 * len(near)
    # the same components as all pairs give, in buckets dealt to many tasks too
    low = {i: i for i in range(len(rows))}
    find = lambda i: i if low[i] == i else find(low[i])
    for g in planted:
        for k, i in enumerate(g):
            for j in g[:k]:
                if copies.jaccard(sets[i], sets[j]) >= 0.8:
                    a, b = sorted((find(i), find(j)))
                    low[b] = a
    got = copies.classes(docs, block=20, chunk=30).join(docs.selectExpr("doc_id", "xxhash64(text) node"), "node").collect()
    least = {}
    for r in got:
        least[r.component] = min(least.get(r.component, r.doc_id), r.doc_id)
    assert sum(least[r.component] != find(r.doc_id) for r in got) <= 0.005 * len(rows)
    assert {g[0] for g in planted} <= left
    # pairs just below the limit stay
    words = [f"w{i}" for i in range(100)]
    apart = " ".join(words[:20] + ["x"] + words[21:50] + ["y"] + words[51:80] + ["z"] + words[81:])
    assert 0.7 < copies.jaccard(copies.shingles(" ".join(words).encode()), copies.shingles(apart.encode())) < 0.8
    docs = spark.createDataFrame([(1, " ".join(words)), (2, apart)], "doc_id long, text string")
    assert cp.near_dedup(spark, docs, SF).count() == 2


def test_one_of_each_by_row(spark):
    """Rows that share an id but not a text are decided one by one; blanks are copies; repeated rows and null ids leave one."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long), (7, "another text of quite different words here"), (8, long + " more"), (9, None), (10, " \n"), (11, "again and again the same"), (11, "again and again the same"), (None, "no id, yet words"), (None, "no id, yet words"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x"))
    got = copies.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)[:20]) for r in got.collect()) == [("11", "again and again the "), ("7", "another text of quit"), ("7", long[:20]), ("9", "None"), ("None", "no id, yet words")]
    assert copies.one_of_each(df.limit(0)).count() == 0


def test_blocks_grow_with_the_table():
    assert copies.shape(50_000) == (13, 43) and copies.shape(10**6)[0] == 17
    for n in (1000, 10**6, 10**9):
        bits, blocks = copies.shape(n)
        assert n / 2**bits <= copies.LOAD and (1 - copies.agreement(0.8) ** bits) ** blocks <= 0.005
