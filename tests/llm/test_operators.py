"""The training-data operators against brute force, round trips and held-out labels, on small fixtures."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stancelake.llm import ann, common, crf_quality, embed_dedup, encode, html_density, mixing, packing, pii, secrets, simhash, token_index
from stancelake.llm.queries import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, a string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def doc(i, text):
    return (i, text, "en", "s", None if text is None else len(text), "x", "y", "z")


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty and very long texts, ties, repeated rows, null ids, clashing column names."""
    rnd = random.Random(3)
    long = " ".join(rnd.choices(WORDS, k=40_000))
    rows = [doc(1, None), doc(2, ""), doc(3, "   \n "), doc(4, long), doc(5, "same text here please"), doc(5, "same text here please"), doc(6, "same text here please"), doc(None, "no id at all"), doc(7, "x" * 50_000), doc(8, "中文 \U0001F600 text naïve\x1c café")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


# --- 1 ------------------------------------------------------------------------------------------


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, odd, none):
    rnd = random.Random(1)
    bits = ["token = ", 'PassWord:"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", " ", "é", "api_key=", "secret  :  ", "x" * 12, "zz\U0001F600"]
    rows = [doc(100 + i, "".join(rnd.choices(bits, k=12))) for i in range(300)]
    df = odd.unionByName(spark.createDataFrame(rows, DOC))
    for r in secrets.scan(df).join(df.select("doc_id", "text").distinct(), "doc_id").collect():
        want = brute_secrets(r.text or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0


def test_guess_costs():
    cheap = ["password123", "qwertyuiop", "aaaaaaaaaaaa", "19990101", "summer2024", "abcabcabcabc", "Password1"]
    dear = ["x9$Kq2!mZp", "b7db7aa4a5fcc78305", "Vt7#pLw0zR"]
    assert max(map(secrets.guesses, cheap)) < secrets.LEAST <= min(map(secrets.guesses, dear))
    assert secrets.guesses("") == 0
    base, added = secrets.find("my pwd: x9$Kq2!mZp! and pwd: password123 and password = abcdefghijkl")
    assert [k for _, k, _ in base] == [0] and len(added) == 1
    # the cheapest cut is no dearer than any cut into segments by hand
    v = "monkeyzx19990101"
    per = math.log10(36)
    assert secrets.guesses(v) <= math.log10(secrets.RANK["monkey"] + 1) + 2 * per + math.log10(200 * 365 * 4) + math.log10(6)


def test_long_secrets():
    """A value is taken whole and cut up whole, however long it is and however far from its word."""
    rnd = random.Random(4)
    for n in (300, 1_600, 100_000):
        key = "".join(rnd.choices("ABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
        for word in ("private_key=", "bearer: ", "pwd      =       "):
            assert secrets.find(f"my {word}{key} after")[1] == [(3 + len(word), 3, 3 + len(word) + n)]
    for cheap in ("-" * 200, "ab" * 400, "abcdefghijklmnopqrstuvwxyz" + "=" * 300, "-" * 100_000, "password" * 9, "secret" + "." * 200 + "2024"):
        assert secrets.find(f"pin: {cheap} after")[1] == []
        assert secrets.guesses(cheap, secrets.LEAST) < secrets.LEAST
    # what lies around a base span within a value is marked beside it
    text = "auth: x9$Kq2!mZp#0123456789abcdef#Vt7#pLw0zR end"
    base, added = secrets.find(text)
    assert [text[a:b] for a, _, b in base] == ["0123456789abcdef"]
    assert [text[a:b] for a, _, b in added] == ["x9$Kq2!mZp#", "#Vt7#pLw0zR"]
    # the bounded search agrees with the full one
    for v in ("".join(rnd.choices(["ab", "1", "qwe", "monkey", "zz", "2001", "#"], k=rnd.randint(1, 7))) for _ in range(300)):
        assert secrets.guesses(v, secrets.LEAST) == min(secrets.guesses(v), secrets.LEAST)


def brute_cost(v, rank):
    """The cheapest of all cuts into brute force, words, dates, repeats and walks, tried one by one."""

    def piece(x):
        kinds = {0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in x}
        out = [len(x) * math.log10(sum((10, 26, 26, 33)[k] for k in kinds))]
        case = 0 if x.islower() else math.log10(2) if x.isupper() or x[1:].islower() else math.log10(2) * len(x)
        low, plain = x.lower(), x.lower().translate(secrets.LEET)
        if low in rank:
            out.append(math.log10(rank[low] + 1) + case)
        elif plain in rank:
            out.append(math.log10(rank[plain] + 1) + case + math.log10(2) * sum(a != b for a, b in zip(low, plain)))
        if (m := secrets.DATE.match(x)) and m.end() == len(x):
            out.append(math.log10(200 * (365 if len(x) > 4 else 1)) + (math.log10(4) if len(x) > 8 else 0))
        if len(x) >= 3 and len(set(x)) == 1:
            out.append(math.log10(secrets._alphabet(x[0]) * len(x)))
        return min(out)

    best = math.inf
    for mask in range(1 << (len(v) - 1)):
        cut = [0, *(i + 1 for i in range(len(v) - 1) if mask >> i & 1), len(v)]
        best = min(best, sum(piece(v[a:b]) for a, b in zip(cut, cut[1:])) + math.log10(math.factorial(len(cut) - 1)))
    return best


def test_cheapest_of_all_cuts():
    """The programme against every cut of short values without walks or longer units."""
    rnd = random.Random(8)
    for _ in range(250):
        v = "".join(rnd.choices(["cat", "D0g", "7", "k", "X", "#", "000", "2019", "q8", "Love"], k=rnd.randint(1, 4)))[:11]
        low = v.lower()
        if any(abs(ord(a) - ord(b)) == 1 or (a, b) in secrets._BESIDE for a, b in zip(low, low[1:])) or re.search(r"(.{2,})\1", v):
            continue
        rank = {"cat": 40, "dog": 700, "love": 3}
        assert abs(secrets.guesses(v, rank=rank) - brute_cost(v, rank)) < 1e-9, v
    words = secrets.dictionary(vocabulary("byte_bpe_50k.json"))
    ten = "password" + "".join(list(secrets.RANK)[5:14])
    assert secrets.guesses(ten) <= sum(math.log10(i + 1) for i in [1, *range(6, 15)]) + math.log10(math.factorial(10)) + 1e-9
    assert len(words) > 20_000


def test_prose_is_no_secret():
    words = secrets.dictionary(vocabulary("byte_bpe_50k.json"))
    for t in ("The secret is understanding each other", "password is required", "login: administrator", "the token is unforgettable", "Authentication is handled elsewhere; auth: middleware"):
        assert secrets.find(t, words) == ([], [])
    assert len(secrets.find("passphrase: correct-horse-battery-staple", words)[1]) == 1
    rnd = random.Random(2)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789#$%&*"
    found = sum(bool(secrets.find(f"pwd: {''.join(rnd.choices(letters, k=12))} ok", words)[1]) for _ in range(300))
    assert found >= 297


# --- 2 ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def mixed(spark):
    rnd = random.Random(5)
    rows, marks = [], []
    for i in range(300):
        toxic, junk = i % 5 == 0, i % 5 == 1
        words = rnd.choices(WORDS, k=rnd.randint(30, 90)) + (["nasty", "vile"] * 3 if toxic else [])
        rnd.shuffle(words)
        text = " ".join(w + "###" for w in words) if junk else " ".join(words)
        rows.append(doc(i, text))
        if i % 2 == 0 or toxic or junk:
            marks.append((i, 0 if junk else 1, 1 if toxic else 0))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_mixing(spark, mixed):
    docs, marks = mixed
    rows = mixing.mix(docs, marks).toPandas()
    p = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and (rows.rate >= 0).all()
    got = (p * (rows.n_tokens * rows.rate).to_numpy()[:, None]).sum(axis=0)
    want = np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    assert np.allclose(got / got.sum(), want, rtol=0.005)
    # the classifier itself: what its most probable domain is
    truth = ["toxic" if i % 5 == 0 else "junk" if i % 5 == 1 else "clean" for i in rows.doc_id]
    assert (np.array(mixing.DOMAINS)[p.argmax(axis=1)] == truth).mean() >= 0.95
    assert not re.search("Python|Pandas|Arrow", mixing.mix(docs, marks)._jdf.queryExecution().toString())


@pytest.mark.parametrize("most,targets", [(None, {"clean": 0.5, "junk": 0.3, "toxic": 0.2}), (1.0, {"clean": 0.5, "junk": 0.3, "toxic": 0.2}), (None, {"clean": 1.0}), (1.0, {"clean": 0.0, "junk": 0.5, "toxic": 0.5})])
def test_rates_are_optimal(spark, most, targets):
    """The squares are as small as another solver makes them, within bounds, where the goals can't be met as well."""
    rng = np.random.default_rng(6)
    p = rng.dirichlet([0.6, 0.4, 0.5], 400)
    tok = rng.integers(1, 400, 400).astype(float)
    own = spark.createDataFrame([(i, int(tok[i]), *map(float, p[i])) for i in range(400)], "doc_id long, n_tokens long, p_clean double, p_junk double, p_toxic double")
    out, goal = mixing.rates(own, targets, most)
    r = out.orderBy("doc_id").toPandas().rate.to_numpy()
    g = np.array([goal[d] for d in mixing.DOMAINS])
    size = np.full(3, g.max())
    squares = lambda r: ((((p * (tok * r)[:, None]).sum(axis=0) - g) / size) ** 2).sum()
    x, a = np.ones(400), p * tok[:, None] / size
    step = 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(20_000):  # plain projected gradient
        x = np.clip(x - step * a @ (x @ a - g / size), 0, most)
    assert (r >= 0).all() and (most is None or (r <= most).all())
    assert squares(r) <= squares(x) + 5 * mixing.TOLERANCE**2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_meets_its_goal(spark, sf):
    from stancelake.llm import queries

    rows = queries.op2_mixing(spark, f"/root/testdata/{sf}").toPandas()
    got = (rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy() * (rows.n_tokens * rows.rate).to_numpy()[:, None]).sum(axis=0)
    assert np.allclose(got / got.sum(), [mixing.TARGETS[d] for d in mixing.DOMAINS], rtol=0.005)


def test_mixing_draw(spark, mixed, odd, none, labels):
    docs, marks = mixed
    out = mixing.draw(docs, marks, {"clean": 0.98, "junk": 0.01, "toxic": 0.01}, most=1.0)
    assert out.columns == docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert len([i for i in range(300) if i % 5 > 1 and i in ids]) >= 176  # clean ones stay
    assert len([i for i in range(0, 300, 5) if i in ids]) < 20
    assert mixing.mix(odd, labels).count() == odd.count()
    assert mixing.mix(none, labels).count() == 0
    assert mixing.mix(odd, labels.limit(0)).count() == odd.count()
    assert mixing.draw(odd, labels).columns == odd.columns


# --- 3 ------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site</header><nav><a href=x>Home</a></nav>
<div class="cookie-notice">We use cookies</div><aside>Side</aside><div id="main"><article><header><h1>Title &amp;amp; more</h1></header>
<p>First <b>bold</b>
 text &lt;here&gt;.<p>Second &copy; para<br>graph.<ul><li>one<li>two</ul><form><input value="a>b">Send</form><script>if (a<b) x("</p>")</script>
<!-- note --><div class="comments"><p>Reader says</p></div></article></div><div class="ad">Buy</div><footer>Foot</footer></body></html>"""


def test_html(spark):
    assert html_density.main_text(PAGE) == "Title &amp; more\n\nFirst bold text <here>.\n\nSecond © para graph.\n\none\n\ntwo"
    assert html_density.main_text("") == html_density.main_text("<html><nav>only</nav>") == ""
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_density.main_text(deep) == "x"
    assert html_density.main_text("<p>a" * 20_000).count("a") == 20_000
    plain = "<body><div class=x><p>" + "word " * 60 + "</p><p>" + "more " * 60 + "</p></div><div><a href=1>l1</a> <a href=2>l2</a> <a href=3>l3</a></div></body>"
    assert html_density.main_text(plain).startswith("word") and "l2" not in html_density.main_text(plain)
    wrapped = '<div class="page has-sidebar"><article class="post ad-free"><p>Kept text here.</p></article><section class="comments"><article class="comment-body"><p>Reader one</p></article></section><div id="sidebar-left"><p>Side</p></div></div>'
    assert html_density.main_text(wrapped) == "Kept text here."
    pages = spark.createDataFrame([(1, "u", PAGE, "q"), (2, None, None, "q"), (None, "v", "<p>x", "q"), (2, None, None, "q")], "page_id long, url string, html string, text string")
    rows = html_density.extract(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows)
    assert html_density.extract(pages.limit(0)).count() == 0


def test_html_keeps_short_parts():
    """Titles, short sections, list headings and loose text beside the densest block stay; link lists don't."""
    long, short = "<p>" + "x" * 300 + "</p>", "<p>" + "y" * 80 + "</p>"
    parts = f"<h1>Twelve chars</h1><div>{long * 10}</div><section><h2>Two</h2>{short * 5}</section>"
    want = ["Twelve chars", *["x" * 300] * 10, "Two", *["y" * 80] * 5]
    assert html_density.main_text(f"<main>{parts}</main>").split("\n\n") == want
    links = "<div><ul>" + "<li><a href=x>Somewhere</a></li>" * 9 + "</ul><p>Plain words beside links.</p></div>"
    assert html_density.main_text(f"<body>{parts}{links}</body>").split("\n\n") == [*want, "Plain words beside links."]
    assert html_density.main_text(f"<body><div><h1>Title</h1></div><div>{long * 10}</div></body>").startswith("Title\n\nxxx")
    assert html_density.main_text(f"<body><div><h1>Title</h1></div><article>{long * 10}</article><div>o</div></body>").startswith("Title\n\nxxx")
    listed = "<section><h2>Steps</h2><p>Do this:</p><ol>" + f"<li>{'z' * 200}</li>" * 20 + "</ol><p>Done.</p></section>"
    text = html_density.main_text(f"<body><div>Loose start.{long * 30}</div>{listed}</body>").split("\n\n")
    assert text[0] == "Loose start." and text[31:33] == ["Steps", "Do this:"] and text[-1] == "Done."
    two = html_density.main_text(f"<body><article>{long * 10}</article><article><p>Second piece.</p></article></body>")
    assert two.endswith("Second piece.")


# --- 4 ------------------------------------------------------------------------------------------


def test_html_names_only_weigh():
    """A class word doesn't delete what holds most of the page; readers' comments go however long they are."""
    long = " ".join(["A sentence of the story that goes on for a while."] * 12)
    paragraphs = f"<p>{long}</p><p>{long} End.</p>"
    want = f"{long}\n\n{long} End."
    assert html_density.main_text(f'<body><div class="menu">Home</div><div class="entry widget">{paragraphs}</div></body>') == want
    assert html_density.main_text(f'<body><div class="post share">{paragraphs}</div><div class="sidebar">Side things</div></body>') == want
    assert html_density.main_text(f'<body><div>{paragraphs}</div><div class="comments">{paragraphs * 4}</div></body>') == want
    assert html_density.main_text(f"<main><div><h1>Title</h1></div><div>{paragraphs}<p><a href=x>A linked paragraph</a></p></div></main>") == f"Title\n\n{want}\n\nA linked paragraph"
    assert html_density.main_text(f"<body><aside data-u=/a/>Aside text</aside><div>{paragraphs}</div></body>") == want
    assert html_density.main_text(f'<body><div><a name="top"/>{paragraphs}</div></body>') == want


def test_html_generated_pages():
    """Pages made of a known article and of furniture: the article comes back whole and nothing else."""
    rnd = random.Random(11)
    words = lambda a, b: " ".join(rnd.choices(WORDS, k=rnd.randint(a, b))).capitalize() + "."
    links = lambda n: "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(n))
    for _ in range(60):
        parts, want = [], []
        for _ in range(rnd.randint(3, 9)):
            kind, text = rnd.choice(["p", "p", "p", "h2", "li", "blockquote"]), words(25, 60)
            if kind == "h2":
                text = words(2, 6)
            parts.append(f"<ul><li>{text}</li></ul>" if kind == "li" else f"<{kind}>{text.replace(' ', chr(10) + ' ', 2)}</{kind}>")
            want.append(text)
        title = words(3, 6)
        body = f"<h1>{title}</h1>" + "".join(parts)
        wrap = rnd.choice(["<article>{}</article>", "<main><div>{}</div></main>", '<div id="content"><article class="post">{}</article></div>', "<main>{}</main>"])
        furniture = [f"<nav><ul>{links(8)}</ul></nav>", f'<div class="sidebar"><ul>{links(12)}</ul><p>{words(5, 20)}</p></div>', f"<footer>{words(4, 12)}</footer>", f'<div class="cookie-notice">{words(6, 20)}</div>', f"<script>var x = '{words(3, 9)}';</script>", f'<section class="comments"><p>{words(20, 200)}</p></section>', f"<form><label>{words(1, 3)}</label><input></form>", f'<div class="ad">{words(3, 9)}</div>', f"<aside>{words(5, 30)}</aside>"]
        rnd.shuffle(furniture)
        at = rnd.randint(0, len(furniture))
        page = f"<html><head><title>{title}</title><style>p {{ color: red }}</style></head><body>" + "".join(furniture[:at]) + wrap.format(body) + "".join(furniture[at:]) + "</body></html>"
        assert html_density.main_text(page) == "\n\n".join([title, *want])


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, ids):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash(spark, odd, none):
    rnd = random.Random(2)
    base = [" ".join(rnd.choices(WORDS, k=120)) for _ in range(6)]
    texts = []
    for i in range(400):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            w[rnd.randrange(len(w))] = rnd.choice(WORDS)
        texts.append(" ".join(w))
    texts += ["", " ", "One", "a b C", "a b c d", "É a b c d"]
    df = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOC)
    rows = {r.doc_id: r for r in simhash.components(df).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    assert all(rows[i].fingerprint == f"{f:016x}" for i, f in enumerate(fp))
    pairs = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4]
    assert {i: r.component_id for i, r in rows.items()} == brute_components(pairs, range(len(fp)))
    assert simhash.components(odd).count() == odd.count() and simhash.components(none).count() == 0


def test_long_runs_are_dealt(spark):
    """A key's fingerprints dealt to pairs of chunks join what one task joins."""
    rng = np.random.default_rng(12)
    fps = sorted({int(x) for x in (rng.integers(0, 1 << 12, 400) << 20 | 5)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    comps = [{r.node: r.component for r in common.connected_components(simhash.near_links(df, 4, block=b)).collect()} for b in (8192, 30)]
    want = brute_components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(fps)))
    for got in comps:
        assert all(got.get(x, x) == fps[want[i]] for i, x in enumerate(fps))


def test_blocks_find_the_same(spark):
    rnd = np.random.default_rng(4)
    seed = rnd.integers(0, 2**63, 40, dtype=np.int64).view(np.uint64)
    fps = np.unique(np.concatenate([seed ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (40, k), dtype=np.uint64), axis=1) for k in (1, 2, 3, 4, 6)] + [seed]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    want = brute_components([(int(a), int(b)) for i, a in enumerate(fps.view(np.int64)) for b in fps.view(np.int64)[:i] if (int(a) ^ int(b)) & (2**64 - 1) and bin((int(a) ^ int(b)) & (2**64 - 1)).count("1") <= 4], [int(x) for x in fps.view(np.int64)])
    for agree in (1, 2, 3, 4):
        cc = common.connected_components(simhash.near_links(df, agree=agree))
        got = {r.node: r.component for r in cc.collect()}
        assert all(got.get(k, k) == v for k, v in want.items())


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (7, 7), (None, 3)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(300)) and got[5001] == 5000
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5 ------------------------------------------------------------------------------------------


def brute_pii(t):
    luhn = lambda d: sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii(spark, odd, none):
    rnd = random.Random(9)
    bits = ["a@b.co", "@", ".", "1", "255", "256", "1.2.3.4", "+1", " (555) 12", "4111111111111111", "4111-1111 1111-1111", "-", " ", "é", "\U0001F600", "x_y", "00", "+44 20 7946 0958"]
    rows = [doc(100 + i, "".join(rnd.choices(bits, k=10))) for i in range(400)]
    df = odd.unionByName(spark.createDataFrame(rows, DOC))
    text = {r.doc_id: r.text for r in df.collect()}
    out = pii.scan(df).collect()
    assert len(out) == df.count()
    for r in out:
        assert r.base_sha256 == hashlib.sha256(brute_pii(text[r.doc_id] or "").encode()).hexdigest()
    assert pii.scan(none).count() == 0
    plan = pii.scan(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def chain(spark):
    """Seeds with a plus; other shapes beside them; then those numbers under a label that no seed has, and new ones there."""
    rows = [f"call me at +1 212 555 {1000 + i} very soon" for i in range(80)] + [f"call me at (212) 555-{2000 + i} very soon" for i in range(12)]
    rows += [f"the fax line: (212) 555-{2000 + i}" for i in range(12)] + ["the fax line: 212/777.3000"] + [f"of the {100000 + i} it saw" for i in range(6)]
    rows += [f"some of the {i} and of the other" for i in range(300)] + [f"of the +1 212 666 {1000 + i} it" for i in range(6)] + ["number 123456789 here"]
    return spark.createDataFrame([doc(i, t) for i, t in enumerate(rows)], DOC), rows


def brute_contexts(rows, rounds):
    """The scores of instances by a plain graph."""
    places, total = [], {}
    for t in rows:
        words = t.lower().split()
        for q in [("before", " ".join(x)) for x in zip(words, words[1:])] + [("after", " ".join(x)) for x in zip(words, words[1:])] + [("label", w) for w in words if w[-1] in ":=#"]:
            total[q] = total.get(q, 0) + 1
        for m in re.finditer(r"\+1 [0-9]{3} [0-9]{3} [0-9]{4}|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}/[0-9]{3}\.[0-9]{4}|[0-9]{6,}", t):
            left, right = t[: m.start()].lower().split(), t[m.end() :].lower().split()
            own = [("before", " ".join(left[-2:]))] * (len(left) > 1) + [("after", " ".join(right[:2]))] * (len(right) > 1) + [("label", left[-1])] * (bool(left) and left[-1][-1] in ":=#")
            places += [(q, m[0], m[0][0] == "+") for q in own]
    score = {v: float(seed) for _, v, seed in places}
    for _ in range(rounds):
        sure = {}
        for q in {q for q, _, _ in places}:
            held = [v for k, v, _ in places if k == q]
            conf = sum(score[v] for v in held) / (max(total.get(q, 0), len(held)) + 1)
            if len({v for v in held if score[v] >= 0.8}) >= 5 and conf >= 0.8:
                sure[q] = min(conf, 0.999)
        for v in {v for _, v, seed in places if not seed}:
            score[v] = 1 - math.prod(1 - sure[q] for q in {k for k, w, _ in places if w == v} if q in sure)
    return score


def test_pii_contexts(spark):
    """Numbers of another shape are found where contexts have held enough seeds, and from those in the next round more."""
    df, rows = chain(spark)
    out = {r.doc_id: r for r in pii.scan(df).collect()}
    found = [i for i in range(len(rows)) if out[i].n_context]
    assert found == list(range(80, 105))
    assert not re.search("Python|Pandas|Arrow", pii.scan(df)._jdf.queryExecution().toString())
    clean = pii.redact(df)
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[82] == "call me at [CONTEXT] very soon" and text[104] == "the fax line: [CONTEXT]" and text[105] == rows[105] and clean.columns == df.columns
    few = [f"call me at +1 212 555 {1000 + i}" for i in range(40)] + [f"call me at (212) 555-{2000 + i}" for i in range(5)]
    out = pii.scan(spark.createDataFrame([doc(i, t) for i, t in enumerate(few)], DOC)).where("n_context = 1").select("doc_id").collect()
    assert sorted(r.doc_id for r in out) == list(range(40, 45))


@pytest.mark.parametrize("rounds", [1, 2, 40])
def test_pii_graph(spark, rounds):
    """The scores are those of a plain graph, round by round; the second step needs the second round."""
    df, rows = chain(spark)
    found = common.settle(pii.spans(df), "t")
    graph = common.settle(pii.edges(found), "t")
    total = graph.groupBy("p").agg(F.sum("n").alias("own")).join(pii.places(df, graph.select("p").distinct()), "p", "left").select("p", F.greatest("own", F.coalesce("n", F.lit(0))).alias("total"))
    _, scores = pii.patterns(graph, common.settle(total, "t"), rounds)
    got = {r.v: r.score for r in scores.collect()}
    want = brute_contexts(rows, rounds)
    assert all(abs(got.get(v, 0.0) - x) < 1e-5 for v, x in want.items())
    assert (got.get("212/777.3000", 0.0) >= 0.8) == (rounds > 1)


def test_pii_many_hits(spark):
    """Places in texts with thousands of matches, over many blocks."""
    text = " ".join(f"é{i} a{i}@b.co 10.0.0.{i % 256}" for i in range(3000))
    r = pii.scan(spark.createDataFrame([doc(1, text)], DOC)).first()
    assert r.n_email == r.n_ip == 3000 and r.base_sha256 == hashlib.sha256(brute_pii(text).encode()).hexdigest()


# --- 6 and 7 ------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, n_links string, part string"


def vectors(seed=0, n=260, d=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, d))
    x = (base[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * rng.choice([0.02, 0.05, 1.0], n)[:, None]).astype(np.float32)
    x[10], x[11] = x[9], x[9]
    rows = [(i, [float(v) for v in x[i]], int(i % 2), "q", "r") for i in range(n)]
    odd = [(1000, None, 1, "q", "r"), (1001, [0.0] * d, 1, "q", "r"), (1002, [float("nan")] * d, 1, "q", "r"), (1003, [None] * d, 1, "q", "r"), (1004, [float(v) for v in x[9]], None, "q", "r"), (1005, [], 0, "q", "r")]
    return x, rows, odd


@pytest.mark.parametrize("block,load", [(4096, 4), (16, 40), (4096, 0.1)])
def test_near_vectors(spark, block, load):
    x, rows, odd = vectors()
    df = spark.createDataFrame(rows + odd, VEC)
    got = {r.vec_id: r for r in embed_dedup.links(df, block=block, load=load).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2)
    np.fill_diagonal(close, False)
    comp = brute_components([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(close)), strict=True)], range(len(x)))
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].n_links == close[i].sum() and got[i].component_id == comp[i] and got[i].kept == (comp[i] == i) for i in range(len(x)))
    assert all(got[1000 + i].n_links == 0 and got[1000 + i].kept for i in range(6))
    assert embed_dedup.links(df.limit(0)).count() == 0


def test_null_and_repeated_vector_ids(spark):
    """Rows are vectors of their own: a null id names no component, a repeated id joins nothing."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((12, 16))
    near = x + 0.01 * rng.standard_normal((12, 16))
    rows = [(i, x[i].tolist(), 0, "", "") for i in range(12)] + [(None, near[i].tolist(), 0, "", "") for i in range(12)]
    got = embed_dedup.links(spark.createDataFrame(rows, VEC)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id is not None) == [(i, 1, i, True) for i in range(12)]
    assert sorted(r.component_id for r in got if r.vec_id is None) == list(range(12)) and not any(r.kept for r in got if r.vec_id is None)
    rows = [(7, x[0].tolist(), 0, "", ""), (7, x[1].tolist(), 0, "", ""), (8, near[0].tolist(), 0, "", ""), (None, x[2].tolist(), 0, "", ""), (None, near[2].tolist(), 0, "", "")]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embed_dedup.links(spark.createDataFrame(rows, VEC)).collect())
    assert got == [("7", 0, 7, True), ("7", 1, 7, True), ("8", 1, 7, False), ("None", 1, None, True), ("None", 1, None, True)]


@pytest.mark.parametrize("rows,dim", [(500, 64), (50_000, 64), (5_000_000, 64), (1_000_000_000, 64), (100_000, 384)])
def test_tables_keep_recall(rows, dim):
    """At every size of a label the tables find nearly all pairs at the limit, and buckets stay small."""
    wide = embed_dedup.widths(rows, dim)
    assert rows / np.prod([2.0 * w for w in wide]) <= embed_dedup.LOAD
    tables = embed_dedup.tables_for(dim, wide, 0.98)
    rng = np.random.default_rng(99)
    x = embed_dedup.units(rng.standard_normal((3000, dim)))
    g = rng.standard_normal((3000, dim))
    g = embed_dedup.units(g - (g * x).sum(axis=1, keepdims=True) * x)
    a, b = (embed_dedup.codes(v, wide, tables) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * g))
    assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= 0.999


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).standard_normal((5, 20))
    y = embed_dedup.rotate(x, 3)
    assert y.shape == (5, 32) and np.allclose((x**2).sum(axis=1), (y**2).sum(axis=1))


def test_search(spark):
    x, rows, odd = vectors(3, 260)
    df = spark.createDataFrame(rows + odd, VEC)
    got = ann.search(df, every=50).collect()
    for q in range(0, 260, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        both = sorted([(d[i], i) for i in range(260) if i != q] + [(math.dist(x[9].astype(float), x[q].astype(float)), 1004)])[:10]
        assert [r for r, _, _ in own] == list(range(1, 11)) and [i for _, i, _ in own] == [i for _, i in both]
        assert np.allclose([s for _, _, s in own], [v for v, _ in both], rtol=0, atol=1e-12)
    assert ann.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("sample,part_rows,fan", [(2000, 500, 64), (1500, 200, 8)])
def test_routed_recall(spark, sample, part_rows, fan):
    """One level of parts, and a tree of them."""
    rng = np.random.default_rng(8)
    x = (rng.standard_normal((40, 24))[rng.integers(0, 40, 6000)] * 1.5 + rng.standard_normal((6000, 24))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0, "", "") for i in range(6000)], VEC)
    assert len(ann.fans(6000, part_rows, fan)) == (1 if fan == 64 else 2)
    got = ann.search(df, every=100, sample=sample, part_rows=part_rows, fan=fan, block=300, query_block=7).collect()
    hit = 0
    for q in range(0, 6000, 100):
        d = ((x.astype(float) - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hit / 600 >= 0.9 and len(got) == 600
    near = ann.neighbours(x[:1000].astype(float), x[:1000].astype(float), 8, True)
    part = ann.partition(x[:1000].astype(float), near, 8)
    assert set(np.bincount(part)) == {125}


def test_parts_at_every_size(spark):
    """Tables of a few hundred rows go through several parts as well, and parts grow with the rows."""
    assert ann.fans(500) == [4] and ann.fans(2000) == [4] and ann.fans(51_282) == [64]
    assert all(0.5 <= np.prod(ann.fans(n)) * ann.PART_ROWS / n <= 2 for n in (10_000, 10**6, 10**9)) and max(ann.fans(10**12)) <= ann.FAN
    x = np.stack([np.array(r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]).astype(float)
    router = ann.fit(x, 4)
    assert router.w.shape[1] == 4 and len(set(router.home(x).tolist())) == 4


def test_search_odd_ids(spark):
    """Copies of a query's vector, a repeated and a null id, another dimension."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 8))
    rows = [(i, x[i].tolist(), 0, "", "") for i in range(1, 80)] + [(100 + i, x[5].tolist(), 0, "", "") for i in range(30)] + [(None, x[6].tolist(), 0, "", "")]
    rows += [(200, x[5].tolist(), 0, "", ""), (200, x[5].tolist(), 0, "", ""), (300, [1.0, 2.0], 0, "", ""), (301, [1.0, 3.0], 0, "", ""), (302, [1.0], 0, "", "")]
    got = {q: [(r.vec_id, r.score) for r in sorted(g, key=lambda r: r.rank)] for q, g in by_query(ann.search(spark.createDataFrame(rows, VEC)).collect()).items()}
    copies = [5, *range(100, 130)]
    assert set(got) == {100, 200, 300}
    assert got[100] == [(i, 0.0) for i in copies if i != 100][:10] and got[200] == [(i, 0.0) for i in copies][:10]
    assert got[300] == [(301, 1.0)]


def by_query(rows):
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append(r)
    return out


# --- 8 and 9 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_are_the_librarys(name, kind):
    e = encode.Encoder(vocabulary(name), kind)
    rnd = random.Random(6)
    letters = [chr(i) for i in range(256)] + list("'''   \n\nthe sre d llvm") * 4
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)] + ["", "a<|endoftext|>b", "it's 'S", "中文 é", "İx", "a’s"]
    want = [np.asarray(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(e.many(texts)) == want == [e.ids(t) for t in texts]
    old, encode.MEMO_ENTRIES, encode.LONG_TEXT = (encode.MEMO_ENTRIES, encode.LONG_TEXT), 10, 30
    try:
        f = encode.Encoder(vocabulary(name), kind)
        assert list(f.many(texts)) == want
    finally:
        encode.MEMO_ENTRIES, encode.LONG_TEXT = old


def ids_of(text, name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def test_index(spark, odd, none):
    got = token_index.index_documents(odd, vocabulary("word_bpe_49k.json")).orderBy("start").collect()
    assert len(got) == odd.count() and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r.doc_id for r in got[1:])
    at = 0
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        ids = ids_of(texts[r.doc_id], "word_bpe_49k.json")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert token_index.index_documents(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_fetch(spark, odd):
    path = common.scratch_path(spark, "test-index")
    token_index.write_index(odd, path, vocabulary("word_bpe_49k.json"))
    shards = token_index.open_index(spark, path)
    name = "word_bpe_49k.json"
    assert token_index.fetch(shards, 4) == [ids_of(odd.where("doc_id = 4").first().text, name)]
    assert token_index.fetch(shards, 5) == [ids_of("same text here please", name)] * 2
    old, token_index.DIRECTORY_KEYS = token_index.DIRECTORY_KEYS, 2
    try:  # several blocks, and shards of one row each, so that a repeated key lies in two of them
        rows, token_index.SHARD_ROWS = token_index.SHARD_ROWS, 1
        small = common.scratch_path(spark, "test-index")
        token_index.write_index(odd.repartition(1), small, vocabulary(name))
        many = token_index.open_index(spark, small)
        assert many.directory.count() > 1
        assert all(token_index.fetch(many, k) == token_index.fetch(shards, k) for k in (None, 1, 2, 5, 8, 999, -4))
    finally:
        token_index.DIRECTORY_KEYS, token_index.SHARD_ROWS = old, rows
    assert token_index.fetch(shards, None) == [ids_of("no id at all", name)] and token_index.fetch(shards, 999) == []


def test_shard_lookups():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 400):
        keys = sorted(rng.choice(10**9, n, replace=False).tolist())
        rows = [None, *keys, keys[-1]]
        ids = [np.arange(i % 7 + 1, dtype="<u4").tobytes() for i in range(n + 2)]
        for width in (2, 4):
            s = token_index.Shard(token_index.build_shard(rows, ids, width))
            assert sorted(s.find(np.array(keys), np.zeros(n, dtype=bool)).tolist() + s.find(np.array([0]), np.array([True])).tolist()) == list(range(n + 1))
            assert [x.tolist() for x in s.rows(keys[-1])] == [list(range(n % 7 + 1)), list(range((n + 1) % 7 + 1))]
            assert s.rows(None)[0].tolist() == [0]
        assert sum(bool(s.rows(int(k))) for k in rng.integers(2 * 10**9, 4 * 10**9, 2000)) == 0


def check_packing(rows, texts, length=2048):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= length
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(ids_of(t, "byte_bpe_50k.json"))
    for d, lists in want.items():
        own = sorted(((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == d))
        assert sum(n for _, n, _, _ in own) == sum(map(len, lists))
        if len(lists) == 1:
            at = 0
            for start, n, crc, tokens in own:
                assert start == at and tokens == len(lists[0]) and crc == zlib.crc32(np.asarray(lists[0][start : start + n], dtype="<u4").tobytes())
                at += n


def test_packing(spark, odd, none):
    path = vocabulary("byte_bpe_50k.json")
    check_packing(packing.pack(odd, path).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(none, path).count() == 0
    rnd = random.Random(4)
    df = spark.createDataFrame([doc(i, " ".join(rnd.choices(WORDS, k=int(rnd.lognormvariate(5.5, 1))))) for i in range(900)], DOC).coalesce(1)
    rows = packing.pack(df, path).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in df.collect()])
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    room = sum(n if n & (n - 1) == 0 else 2048 for n in used.values())
    assert sum(used.values()) / room > 0.99


def test_differencing():
    rnd = random.Random(7)
    for k in (1, 2, 5, 30):
        sizes = [rnd.randint(1, 900) for _ in range(120)]
        w = packing.difference(sizes, k)
        assert len(w) == k and sorted(i for x in w for i in x) == list(range(120))
        sums = [sum(sizes[i] for i in x) for x in w]
        assert max(sums) - min(sums) <= max(sizes)
    assert packing.difference([8, 7, 6, 5, 4], 2) and sorted(sum([8, 7, 6, 5, 4][i] for i in x) for x in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]
    assert packing.difference([], 3) == [[], [], []] and packing.deal([]) == []
    for size in (1100, 1500, 2047, 2048, 1):
        windows = packing.deal([(i, 0, size) for i in range(64)])
        assert all(sum(n for _, _, n in w) <= 2048 for w in windows) and sum(n for w in windows for _, _, n in w) == 64 * size


# --- 10 -----------------------------------------------------------------------------------------


def brute_marginals(s, trans):
    from itertools import product

    total, good = 0.0, np.zeros(len(s))
    for y in product((0, 1), repeat=len(s)):
        w = math.exp(sum(s[i] for i in range(len(s)) if y[i]) + sum(trans[y[i - 1], y[i]] for i in range(1, len(s))))
        total += w
        good += w * np.array(y)
    return good / total, math.log(total)


def test_forward_backward():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 5, 3, 8, 2])
    s, trans = rng.standard_normal(sizes.sum()) * 2, rng.standard_normal((2, 2))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    p, z, _ = crf_quality.marginals(s, starts, sizes, trans)
    for a, n, lz in zip(starts, sizes, z, strict=True):
        want, log_z = brute_marginals(s[a : a + n], trans)
        assert np.allclose(p[a : a + n], want) and math.isclose(lz, log_z)
        assert np.allclose(crf_quality.long_marginals(s[a : a + n], trans), want)


def test_gradient_of_fit():
    """Line features of a run of texts are those of each text alone."""
    texts = ["One line.\n\nTWO!! LINES!!", "", "a a a a a", "é ### | 12\n", "\n\n", "x"]
    x, doc_, length = crf_quality.line_features(texts)
    for i, t in enumerate(texts):
        y, _, n = crf_quality.line_features([t])
        assert np.allclose(x[doc_ == i], y) and length[doc_ == i].tolist() == n.tolist()
    rnd = random.Random(5)
    long = "\n".join(" ".join(rnd.choices(WORDS, k=rnd.randint(0, 9))) for _ in range(3000))
    one, many = crf_quality.line_features([long], size=10**9), crf_quality.line_features([long], size=700)
    assert all(np.array_equal(a, b) for a, b in zip(one, many, strict=True)) and one[0][:, crf_quality.REPEAT].sum() > 0
    # what stands beside a document doesn't change its lines
    beside = crf_quality.line_features([long[:5000]] * 3 + ["x y z\n" * 50])
    alone = crf_quality.line_features([long[:5000]])
    assert np.array_equal(beside[0][beside[1] == 2], alone[0])


def test_quality_held_out(spark, odd, none, labels):
    docs, marks = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = crf_quality.quality(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert len(out) > 500 and ((out.predicted == out.quality).mean()) > 0.97
    assert out[out.quality == 1].predicted.mean() > 0.98
    own = crf_quality.quality(odd, labels)
    assert own.count() == odd.count() and own.where("score is null or score < 0 or score > 1").count() == 0
    assert crf_quality.quality(none, labels).count() == 0
    assert crf_quality.quality(odd, labels.limit(0)).count() == odd.count()
    r = {r.doc_id: r.held_out for r in own.collect()}
    assert all(r[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in r if i is not None) and r[None] is False
    again = crf_quality.score(odd, crf_quality.fit(["Good text here."], [1]))
    assert again.columns == [c for c in odd.columns if c != "score"] + ["score"]


def test_long_documents_agree():
    rnd = random.Random(1)
    good = ["\n".join(" ".join(rnd.choices(WORDS, k=9)) + "." for _ in range(6)) for _ in range(60)]
    bad = ["\n".join("### " + " ".join(w.upper() + "!!" for w in rnd.choices(WORDS, k=5)) for _ in range(6)) for _ in range(60)]
    m = crf_quality.fit(good + bad, [1] * 60 + [0] * 60)
    text = "\n".join(" ".join(rnd.choices(WORDS, k=9)) + "." for _ in range(3000))
    one = m.raw([text, good[0]])
    old, crf_quality.LONG = crf_quality.LONG, 10**9
    try:
        assert np.allclose(one, m.raw([text, good[0]]))
    finally:
        crf_quality.LONG = old
    assert (m.quality(good[:20]) >= 0.7).all() and (m.quality(bad[:20]) < 0.7).all()
