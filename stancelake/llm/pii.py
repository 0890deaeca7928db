"""Personal data by fixed patterns and by bootstrapped contexts, in JVM expressions alone.

Base kinds are plain patterns with a check each. The method adds spans. Every
base span is a seed; number groups that are no base span are candidates. The
lexical patterns of both are what stands around them, whatever they look like
themselves: the two words before, the two words after, and the word before
where it ends like a label. Over the graph of patterns and instances, rounds
score a pattern by the scores of the places that it holds over all places
where its words stand in the corpus at all (so "of the" is a poor pattern),
and an instance by the chance that any of its sure patterns is right; seeds
keep score 1. A pattern is sure with `LEAST_CONFIDENCE` and with `LEAST_SUPPORT`
distinct instances that are seeds or were found in earlier rounds, so what a
round finds lets the next one reach new patterns. Rounds end when nothing new
is found. Candidates with a sure pattern beside them and a score of
`LEAST_SCORE` are reported as kind `context`.

Positions come from the pieces between matches: Spark's split() and
regexp_extract_all() walk the same matches, and length() counts code points.
The patterns are written with possessive quantifiers, which match the same
here and keep Java's matcher iterative on very long texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import settle

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
#: \G: right after the last match; otherwise a match can't begin inside a run that it would have begun with.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Groups of six digits or more, with up to three letters before them.
CANDIDATE = r"(?<![0-9A-Za-z+])(?:[+(]|[A-Za-z]{1,3}+)?+[0-9](?:[ ()./-]{0,2}+[0-9]){5,}+(?![0-9A-Za-z])"
#: ROUNDS only guards the loop: scores rise from round to round until they stay the same to six places.
ROUNDS = 50
LEAST_SUPPORT, LEAST_CONFIDENCE, LEAST_SCORE = 5, 0.8, 0.8
#: Patterns up to this number are broadcast to count their places.
FEW = 100_000
_SPAN = "struct<s:int,e:int,t:string,l:string,r:string>"
_BLANK = r"[ \t\r\n]"


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return acc + F.when((n - i) % 2 == 1, F.element_at(twice, d + 1)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, t: Column) -> Column:
    if kind == "ip":

        def small(part: Column) -> Column:
            bare = F.regexp_replace(part, "^0+(?=.)", "")
            return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int"), F.lit(256)) <= 255).otherwise(F.lit(False))

        return F.forall(F.split(t, r"\."), small)
    if kind == "card":
        d = _digits(t)
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda x: _passes(kind, x["t"])


def _named(kind: str):
    return lambda x: F.concat_ws(":", F.lit(kind), x["s"], x["e"])


def _mark(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{kind.upper()}]").alias("k"))


def _places(hits: str, gaps: str, block: int = 128) -> Column:
    """The matches as structs: start, end (code points), text, and the two words before and after.

    Folds copy what they have gathered, so they run over blocks of matches, each from its own start.
    """
    gap, hit = f"{gaps}[i - 1]", f"{hits}[i - 1]"
    start = f"a.pos + length({gap})"
    word = "[^ \\\\t\\\\r\\\\n]{1,40}"
    left = f"lower(regexp_extract(substring({gap}, -120), '((?:{word}[ \\\\t\\\\r\\\\n]+)?{word})[ \\\\t\\\\r\\\\n]*$', 1))"
    right = f"lower(regexp_extract(substring({gaps}[i], 1, 120), '^[ \\\\t\\\\r\\\\n]+({word}[ \\\\t\\\\r\\\\n]+{word})', 1))"
    span = f"named_struct('s', {start}, 'e', {start} + length({hit}), 't', {hit}, 'l', {left}, 'r', {right})"
    none, n = f"cast(array() as array<{_SPAN}>)", f"size({hits})"
    blocks = f"sequence(0, ({n} - 1) div {block})"
    size = f"aggregate(sequence(b * {block} + 1, least(b * {block} + {block}, {n})), 0, (x, i) -> x + length({gap}) + length({hit}))"
    starts = f"aggregate(transform({blocks}, b -> {size}), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    run = f"aggregate(sequence(b * {block} + 1, least(b * {block} + {block}, {n})), named_struct('pos', x, 'out', {none}), (a, i) -> named_struct('pos', {start} + length({hit}), 'out', concat(a.out, array({span}))), a -> a.out)"
    return F.expr(f"if({n} > 0, flatten(zip_with({blocks}, slice({starts}, 1, ({n} - 1) div {block} + 1), (b, x) -> {run})), {none})")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, a span array for each kind, candidates) of every row; null text counts as empty.

    row_key is a hash of the id and the text: rows that share it are the same.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    every = {**PATTERNS, "candidate": CANDIDATE}
    none = F.array().cast("array<string>")
    digits = F.col("text").rlike("[0-9]")
    guards = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    df = df.withColumn("digits", digits)
    df = df.withColumns({f"h_{k}": F.when(guards.get(k, F.lit(True)) & (F.col("digits") if k != "email" else F.lit(True)), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in every.items()})
    df = df.withColumns({f"g_{k}": F.when(F.size(f"h_{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in every.items()})
    df = df.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), *[_places(f"h_{k}", f"g_{k}").alias(k) for k in every])
    df = df.withColumns({k: F.filter(k, _check(k)) for k in KINDS})
    base = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("candidate", lambda c: F.length(_digits(c["t"])).between(6, 20) & ~F.exists(base, lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
    return df.withColumn("candidate", F.when(F.size("candidate") > 0, free).otherwise(F.col("candidate")))


def _patterns(x: str) -> Column:
    """The lexical patterns of a place x: what kind, and the words."""
    l, r = (F.regexp_replace(F.col(f"{x}.{c}"), f"{_BLANK}+", " ") for c in "lr")
    two, label = l.contains(" "), F.regexp_extract(l, "([^ ]+[:=#])$", 1)
    return F.filter(F.array(F.when(two, F.concat(F.lit("before "), l)), F.when(r != "", F.concat(F.lit("after "), r)), F.when(label != "", F.concat(F.lit("label "), label))), F.isnotnull)


def edges(found: DataFrame) -> DataFrame:
    """(p, v, n, seed) of a table of spans: pattern, instance, in how many places, and 1 where it is a base span."""
    parts = [found.where(F.size(k) > 0).select(F.explode(k).alias("x")).select(F.explode(_patterns("x")).alias("p"), F.lower("x.t").alias("v"), F.lit(0.0 if k == "candidate" else 1.0).alias("seed")) for k in (*KINDS, "candidate")]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    return rows.groupBy("p", "v").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))


def places(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(p, n): how often the words of the patterns of known(p) stand in texts(text), whatever is beside them."""
    words = texts.select(F.array_remove(F.split(F.lower("text"), f"{_BLANK}+"), "").alias("w"))
    pairs = words.where(F.size("w") > 1).select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> concat(w[i - 1], ' ', w[i]))")).alias("q"))
    single = words.select(F.explode(F.filter("w", lambda x: x.rlike("[:=#]$"))).alias("q"))
    keys = known.select("p", F.regexp_replace("p", "^[a-z]+ ", "").alias("q"), (F.col("p").startswith("label ")).alias("one"))
    keys = settle(keys, "pii-known")
    if keys.count() <= FEW:
        keys = F.broadcast(keys)
    both = pairs.join(keys.where("not one"), "q").select("p").union(single.join(keys.where("one"), "q").select("p"))
    return both.groupBy("p").agg(F.count("*").alias("n"))


def patterns(graph: DataFrame, total: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(sure patterns, instances with their score) of written edges and written totals (p, total) of places, after so many rounds."""
    return _spread(graph, total, rounds)[:2]


def _spread(graph: DataFrame, total: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame, bool]:
    """As patterns, and whether the last round found nothing new."""
    sure = None
    scores = settle(graph.groupBy("v").agg(F.max("seed").alias("score")), "pii-scores")
    seeds = settle(scores.where("score > 0"), "pii-seeds")
    was = None
    for i in range(rounds):
        # both sides of every join are written tables, so that Spark can split a pattern with very many instances
        held = graph.join(scores, "v").groupBy("p").agg(F.sum(F.col("n") * F.col("score")).alias("held"), F.count_if(F.col("score") >= LEAST_SCORE).alias("support"))
        sure = held.join(total, "p").withColumn("confidence", F.col("held") / (F.col("total") + 1))
        sure = settle(sure.where((F.col("support") >= LEAST_SUPPORT) & (F.col("confidence") >= LEAST_CONFIDENCE)).select("p", "confidence"), f"pii-sure-{i}")
        found = graph.join(sure, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = settle(found.join(seeds.select("v"), "v", "left_anti").union(seeds), f"pii-scores-{i}")
        now = (sure.count(), scores.agg(F.count_if(F.col("score") >= LEAST_SCORE), F.sum(F.round("score", 6).cast("decimal(20,6)"))).first())
        if now == was:
            return sure, scores, True
        was = now
    return sure, scores, False


def discovered(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """(doc_id, row_key, context): the candidates that sure patterns hold, by row of found that has any; None if there are none."""
    graph = settle(edges(found), "pii-edges")
    # what can ever be sure: enough distinct instances, and a candidate to gain
    known = settle(graph.groupBy("p").agg(F.count("*").alias("support"), F.sum("n").alias("own")).where(F.col("support") >= LEAST_SUPPORT), "pii-patterns")
    graph = settle(graph.join(known.select("p"), "p"), "pii-graph")
    if graph.where("seed = 0").isEmpty():
        return None
    total = known.join(places(texts, known), "p", "left").select("p", F.greatest("own", F.coalesce("n", F.lit(0))).alias("total"))
    sure, scores, done = _spread(graph, settle(total, "pii-total"), rounds)
    if not done:
        raise RuntimeError(f"patterns still lead to new instances after {rounds} rounds")
    x = found.where(F.size("candidate") > 0).select("doc_id", "row_key", F.explode("candidate").alias("x")).distinct()
    x = x.select("doc_id", "row_key", "x", F.explode(_patterns("x")).alias("p"), F.lower("x.t").alias("v"))
    kept = x.join(sure, "p", "left_semi").join(scores.where(F.col("score") >= LEAST_SCORE), "v", "left_semi").select("doc_id", "row_key", "x").distinct()
    return kept.groupBy("row_key").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("x")).alias("context"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Span arrays of every row of docs: the base kinds and `context` (see discovered).

    A null or empty text has no spans; a very long one is read whole; a null
    id is kept; repeated rows give repeated rows, and count as places of their
    own; an empty table gives none; other columns aren't read, whatever their
    names.
    """
    found = settle(spans(docs, id_col, text_col), "pii-spans")
    none = F.array().cast(f"array<{_SPAN}>")
    more = discovered(found, docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")))
    if more is None:
        return found.select("doc_id", "row_key", *KINDS, none.alias("context"))
    more = more.select(F.col("row_key").alias("k2"), F.col("doc_id").alias("d2"), "context")
    joined = found.join(more, (F.col("row_key") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("d2")), "left")
    return joined.select("doc_id", "row_key", *KINDS, F.coalesce("context", none).alias("context"))


def _line(kinds: tuple[str, ...]) -> Column:
    return F.concat_ws(",", *[F.transform(k, _named(k)) for k in kinds])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_context, base_sha256, spans) of every row; see annotate for odd rows."""
    own = annotate(docs, id_col, text_col)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "context")]
    return own.select("doc_id", *counts, F.sha2(_line(KINDS), 256).alias("base_sha256"), _line((*KINDS, "context")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets, of spans that overlap the first one alone.

    All columns stay, whatever their names, and rows without spans as they
    are, null and empty texts among them. Rows keep their number, repeated
    ones and those without an id too; an empty table gives none.
    """
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])  # no name of docs can meet one of ours
    at = docs.columns.index(text_col)
    own = annotate(plain.select(F.col(f"_c{docs.columns.index(id_col)}").alias("doc_id"), F.col(f"_c{at}").alias("text")))
    tagged = F.concat(*[F.transform(k, _mark(k)) for k in (*KINDS, "context")])
    marks = own.select(F.col("row_key").alias("mark_key"), F.col("doc_id").alias("mark_id"), F.array_sort(tagged).alias("marks")).where(F.size("marks") > 0)
    marks = marks.dropDuplicates(["mark_key", "mark_id"])
    keyed = plain.withColumns({"whole": F.coalesce(F.col(f"_c{at}").cast("string"), F.lit("")), "own_id": F.col(f"_c{docs.columns.index(id_col)}").cast("long")}).withColumn("own_key", F.xxhash64("own_id", "whole"))
    # marks grow with the rows, so they are merged at every size and never broadcast
    joined = keyed.join(marks.hint("merge"), (F.col("own_key") == F.col("mark_key")) & F.col("own_id").eqNullSafe(F.col("mark_id")), "left")
    out = F.when(F.col("marks").isNotNull(), F.expr(_replaced("marks", "whole"))).otherwise(F.col(f"_c{at}"))
    return joined.select(*[out.alias(c) if i == at else F.col(c) for i, c in enumerate(plain.columns)]).toDF(*docs.columns)


def _replaced(marks: str, whole: str, block: int = 128) -> str:
    """SQL for a text with its sorted marks in place of what they cover.

    A mark that ends within an earlier one counts for nothing. Marks are taken
    in blocks, and each block cuts its own stretch of the text, as a cut
    counts characters from the start of what it cuts.
    """
    own = f"slice({marks}, b * {block} + 1, {block})"
    blocks = f"sequence(0, (size({marks}) - 1) div {block})"
    reach = f"slice(aggregate({blocks}, array(0), (a, b) -> concat(a, array(greatest(element_at(a, -1), array_max(transform({own}, x -> x.e)))))), 1, (size({marks}) - 1) div {block} + 1)"
    none = "cast(array() as array<struct<f:int,s:int,e:int,k:string>>)"
    step = "if(x.e <= a.pos, a, named_struct('pos', x.e, 'out', concat(a.out, array(named_struct('f', a.pos, 's', greatest(x.s, a.pos), 'e', x.e, 'k', x.k)))))"
    kept = f"filter(zip_with({blocks}, {reach}, (b, r) -> aggregate({own}, named_struct('pos', r, 'out', {none}), (a, x) -> {step}, a -> a.out)), g -> size(g) > 0)"
    cut = f"substring({whole}, g[0].f + 1, element_at(g, -1).e - g[0].f)"
    made = f"transform(array({cut}), c -> array_join(transform(g, x -> concat(substring(c, x.f - g[0].f + 1, x.s - x.f), x.k)), ''))[0]"
    last = f"array_max(transform({marks}, x -> x.e))"
    return f"concat(array_join(transform({kept}, g -> {made}), ''), substring({whole}, {last} + 1, length({whole})))"
