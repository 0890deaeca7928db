"""Soft-membership mixing of a corpus to target weights, in JVM expressions alone.

A labelled table teaches a multinomial logistic model over telling words and
surface features; it gives every document a posterior over domains. A document's
expected tokens in a domain are its tokens times that posterior. Projected
gradient steps of least squares fit a nonnegative rate for every document, so
that the expected totals of the domains meet their targets. The steps are lazy:
a document's rate is the projection onto the bounds of one plus its posterior
times the sum of all gradients so far, a vector of one number a domain. The
gradient (the domains' residuals) is scaled by the inverse Gram matrix of the
documents off their bounds, so a few steps suffice, and an iteration is one
aggregate over a narrow table that tries a few lengths of the step at once; the
driver holds a few numbers. A small pull towards rate one makes the optimum
unique where goals can be met, and the least squares' own where they can't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancelake.llm.common import settle

DOMAINS = ("clean", "junk", "toxic")
#: Shares of the tokens that are kept, by domain.
TARGETS = {"clean": 0.95, "junk": 0.02, "toxic": 0.03}
#: Labelled documents that the model is fitted on, at most: those with the smallest hashes of their ids.
FIT_DOCUMENTS = 8000
#: Words that the model keeps, at most; the documents that each must stand in, and how telling it must be, at least.
WORDS, LEAST_SUPPORT, LEAST_TELL = 48, 6, 6.0
#: The pull towards rate one, weaker from stage to stage as long as that brings the goals nearer; the residual left in a
#: gradient, as a share of a domain's goal (or of FLOOR of all goals, where it is smaller); the lengths of a step that are
#: tried. ITERATIONS only guards the loop of a stage; a result further off than UNSOLVED is an error.
PULLS, TOLERANCE, FLOOR, LENGTHS, ITERATIONS, UNSOLVED = (1e-4, 1e-6, 1e-8), 5e-4, 0.01, (1.0, 0.3, 0.1, 0.03, 0.01, 0.001), 60, 5e-3

# Surface features of a text: shares of characters and words, and whether they pass a bound.
_FEATURES = {
    "marks": "marks / chars",
    "many_marks": "cast(marks > 0.02 * chars as double)",
    "capitals": "capitals / chars",
    "many_capitals": "cast(capitals > 0.3 * chars as double)",
    "digits": "digits / chars",
    "distinct": "size(words) / greatest(n_tokens, 1)",
    "repeats": "cast(size(words) < 0.4 * n_tokens as double)",
    "size": "ln(1.0 + n_tokens)",
    "short": "cast(n_tokens < 20 as double)",
    "word_length": "least(chars / greatest(n_tokens, 1), 40.0)",
}


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic before junk before clean; null ids and labels that are null throughout don't count."""
    y = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"), F.avg("quality").alias("quality"))
    y = y.where("toxic is not null or quality is not null")
    return y.select("doc_id", F.when(F.col("toxic") >= 1, "toxic").when(F.col("quality") < 0.5, "junk").otherwise("clean").alias("domain"))


def featured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_tokens, words, f_<feature>): words are distinct, in lower case; null text counts as empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"))
    df = df.withColumn("tokens", F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), ""))
    df = df.withColumns(
        {
            "n_tokens": F.size("tokens").cast("long"),
            "words": F.array_distinct("tokens"),
            "chars": F.greatest(F.length("text"), F.lit(1)).cast("double"),
            "marks": F.regexp_count("text", F.lit(r"[#$%&*|!<>{}\[\]~^=]")),
            "capitals": F.regexp_count("text", F.lit("[A-Z]")),
            "digits": F.regexp_count("text", F.lit("[0-9]")),
        }
    )
    return df.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "n_tokens", "words", *[F.expr(x).alias(f"f_{k}") for k, x in _FEATURES.items()])


class Model:
    """Scores of domains: an intercept, and what each feature and each known word adds."""

    def __init__(self, intercept: list[float], features: dict[str, list[float]], words: dict[str, list[float]]):
        self.intercept, self.features, self.words = intercept, features, words

    def posteriors(self, df: DataFrame) -> DataFrame:
        """(doc_id, row_key, n_tokens, p_<domain>) from a featured table."""
        known = F.array(*[F.lit(w) for w in self.words]) if self.words else F.array().cast("array<string>")
        df = df.withColumn("hits", F.array_intersect("words", known))
        scores = []
        for d in range(len(DOMAINS)):
            total = F.lit(self.intercept[d])
            for k, v in self.features.items():
                total = total + F.col(f"f_{k}") * v[d]
            if self.words:
                weight = F.create_map(*[F.lit(x) for w, v in self.words.items() for x in (w, v[d])])
                total = total + F.aggregate("hits", F.lit(0.0), _adder(weight))
            scores.append(total.alias(f"l{d}"))
        df = df.select("doc_id", "row_key", "n_tokens", *scores)
        top = F.greatest(*[F.col(f"l{d}") for d in range(len(DOMAINS))])
        parts = [F.exp(F.col(f"l{d}") - top) for d in range(len(DOMAINS))]
        whole = reduce(lambda a, b: a + b, parts)
        return df.select("doc_id", "row_key", "n_tokens", *[(p / whole).alias(f"p_{d}") for d, p in zip(DOMAINS, parts, strict=True)])


def _adder(weight: Column):
    return lambda a, w: a + F.element_at(weight, w)


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCUMENTS) -> Model:
    """A multinomial logistic model of the labelled documents.

    With labelled documents of one domain alone, that domain gets (nearly)
    all of every posterior; without any, posteriors are even.
    """
    domain = domain_of(labels)
    chosen = domain.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # at most `bound` ids
    wide = docs.join(F.broadcast(chosen.select(F.col("doc_id").alias("__y_id"))), docs["doc_id"].cast("long") == F.col("__y_id"), "left_semi")
    rows = settle(featured(wide.select("doc_id", "text")).dropDuplicates(["row_key"]).join(F.broadcast(chosen), "doc_id"), "mixing-sample")
    n = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}  # a row a domain
    total = sum(n.values())
    if len(n) < 2:
        return Model([20.0 if d in n else 0.0 for d in DOMAINS], {}, {})
    counts = rows.select("domain", F.explode("words").alias("w")).where(F.length("w").between(2, 40)).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    everywhere = reduce(lambda a, b: a + b, [F.col(d) for d in DOMAINS])
    # how far a word's count in a domain is from what its count in all would give, in standard deviations
    tells = [(F.col(d) - everywhere * (n[d] / total)) / F.sqrt(everywhere * (n[d] / total)) for d in DOMAINS if d in n]
    told = counts.where(everywhere >= LEAST_SUPPORT).withColumn("tell", F.greatest(*tells))
    top = told.where(F.col("tell") >= LEAST_TELL).orderBy(F.desc("tell"), "w").limit(WORDS)
    words = [r["w"] for r in top.select("w").collect()]  # WORDS rows at most
    names = [f"f_{k}" for k in _FEATURES] + [f"w_{i}" for i in range(len(words))]
    flags = {f"w_{i}": F.array_contains("words", w).cast("double") for i, w in enumerate(words)}
    index = F.element_at(F.create_map(*[x for i, d in enumerate(DOMAINS) for x in (F.lit(d), F.lit(float(i)))]), F.col("domain"))
    sample = VectorAssembler(inputCols=names, outputCol="x").transform(rows.withColumns(flags).withColumn("y", index)).select("x", "y").coalesce(1)  # `bound` rows of a few numbers
    found = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=1e-4, maxIter=100).fit(sample)
    b, w = found.interceptVector.toArray().tolist(), found.coefficientMatrix.toArray().tolist()
    b = [max(x, -50.0) for x in b] + [-50.0] * (len(DOMAINS) - len(b))
    w += [[0.0] * len(names)] * (len(DOMAINS) - len(w))
    columns = [[row[k] for row in w] for k in range(len(names))]
    return Model(b, dict(zip(_FEATURES, columns[: len(_FEATURES)], strict=True)), dict(zip(words, columns[len(_FEATURES) :], strict=True)))


def _moved(at: list[float]) -> Column:
    """One plus the posterior times the gradients so far: the rate before its projection."""
    return reduce(lambda a, b: a + b, [F.lit(1.0)] + [F.col(f"p_{d}") * float(x) for d, x in zip(DOMAINS, at, strict=True)])


def _projected(z: Column, most: float | None) -> Column:
    z = F.greatest(F.lit(0.0), z)
    return z if most is None else F.least(F.lit(float(most)), z)


def rates(own: DataFrame, targets: dict[str, float], most: float | None = None) -> tuple[DataFrame, dict[str, float]]:
    """own with `rate`, and the goal of each domain in tokens.

    Goals keep the shares of `targets` (zero weights allowed), at the total
    that leaves the domain of the largest weight its tokens; with `most`, a
    goal is what so many copies of a domain can give at most. What is made
    small is the sum of the squared residuals in tokens, and a pull (`PULLS`) times the
    squared distances of the rates from one. So where goals can't all be met,
    tokens of a large domain aren't given up by the thousand for a share of a
    small one. What is solved is the dual of that problem, which is smooth and
    convex and has a number a domain: steps are its gradient times the inverse
    Gram matrix of the documents off their bounds, with the best of a few
    lengths, and the rates are the projection. They end where the gradient is
    `TOLERANCE` of the goals, or where rounding leaves no descent; if it is then
    still over `UNSOLVED` of them, that is an error and no rates come out.
    """
    k = len(DOMAINS)
    p = [F.col(f"p_{d}") for d in DOMAINS]
    tok = F.col("n_tokens").cast("double")
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def measure(points: list[list[float]]) -> list[tuple[list[float], list[list[float]], float]]:
        """For each point: the domains' tokens, the Gram matrix of the documents off their bounds, the dual's sum over documents."""
        sums = []
        for at in points:
            z = _moved(at)
            r = _projected(z, most)
            free = z >= 0 if most is None else (z >= 0) & (z <= most)
            sums += [F.sum(tok * r * x) for x in p] + [F.sum(F.when(free, tok * p[i] * p[j])) for i, j in upper] + [F.sum(tok * r * (z - r / 2))]
        got = [float(x) for x in own.agg(*[F.coalesce(x, F.lit(0.0)).alias(f"s{i}") for i, x in enumerate(sums)]).first()]
        out, width = [], k + len(upper) + 1
        for n in range(len(points)):
            own_sums = got[n * width : (n + 1) * width]
            gram = [[0.0] * k for _ in range(k)]
            for (i, j), x in zip(upper, own_sums[k:-1], strict=True):
                gram[i][j] = gram[j][i] = x
            out.append((own_sums[:k], gram, own_sums[-1]))
        return out

    at = [0.0] * k
    now = measure([at])[0]
    has = now[0]
    share = [targets.get(d, 0) / sum(targets.values()) for d in DOMAINS]
    anchor = max(range(k), key=lambda i: share[i])
    total = has[anchor] / share[anchor]
    goal = [total * s if most is None else min(total * s, most * h) for s, h in zip(share, has, strict=True)]
    size = [max(g, FLOOR * sum(goal)) for g in goal]
    def dual(x: list[float], state: tuple, pull: float) -> float:
        return state[2] + sum(pull * a * a / 2 - g * a for a, g in zip(x, goal, strict=True))

    def missed(tokens: list[float]) -> float:
        return max(abs(g - t) / s for g, t, s in zip(goal, tokens, size, strict=True)) if total else 0.0

    before = float("inf")
    for pull in (p * max(size) for p in PULLS):
        if missed(now[0]) <= TOLERANCE or missed(now[0]) > before / 2:
            break  # there, or no nearer for the weaker pull: beside the goals lies the optimum
        before = missed(now[0]) if any(at) else before
        for _ in range(ITERATIONS):
            left = [g - t - pull * a for g, t, a in zip(goal, now[0], at, strict=True)]
            if all(abs(x) <= TOLERANCE / 2 * s for x, s in zip(left, size, strict=True)):
                break
            slack = pull + 1e-9 * max(sum(has), 1.0)
            step = _solved([[x + (slack if i == j else 0.0) for j, x in enumerate(row)] for i, row in enumerate(now[1])], left)
            points = [[a + f * x for a, x in zip(at, step, strict=True)] for f in LENGTHS]
            then, state = min(zip(points, measure(points), strict=True), key=lambda x: dual(*x, pull))
            if dual(then, state, pull) >= dual(at, now, pull):
                break
            at, now = then, state
        left = [g - t - pull * a for g, t, a in zip(goal, now[0], at, strict=True)]
        off = max(abs(x) / s for x, s in zip(left, size, strict=True))
        if off > UNSOLVED:
            raise RuntimeError(f"rates are {off:.3g} of the goals off their optimum after {ITERATIONS} steps at most")
    return own.withColumn("rate", _projected(_moved(at), most)), dict(zip(DOMAINS, goal, strict=True))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small symmetric positive system."""
    n = len(right)
    rows = [[*row, x] for row, x in zip(matrix, right, strict=True)]
    for i in range(n):
        at = max(range(i, n), key=lambda j: abs(rows[j][i]))
        rows[i], rows[at] = rows[at], rows[i]
        for j in range(n):
            if j != i:
                f = rows[j][i] / rows[i][i]
                rows[j] = [x - f * y for x, y in zip(rows[j], rows[i], strict=True)]
    return [rows[i][n] / rows[i][i] for i in range(n)]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = None) -> DataFrame:
    """(doc_id, row_key, n_tokens, p_<domain>..., rate) of every row of docs.

    Null and empty texts have no tokens: they weigh nothing and get the rate
    that their posterior gives. Very long texts count whole. A null id is kept;
    repeated rows count each; rows with the same posterior have the same rate;
    an empty table gives no rows; other columns aren't read, whatever their names.
    """
    model = fit(docs, labels)
    own = settle(model.posteriors(featured(docs)), "mixing-posteriors")
    return rates(own, targets or TARGETS, most)[0]


def draw(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float | None = 1.0) -> DataFrame:
    """docs at their rates: a row stays or repeats floor(rate) times, once more if its hash falls below the rest.

    All columns stay, whatever their names. Rows that are the same have the
    same fate, so copies of one row stay or go together; null ids and null or
    empty texts are drawn like any others; very long texts count whole; an
    empty table gives no rows.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # no name of docs can meet one of ours
    plain = docs.toDF(*names)
    own_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    own = mix(plain.select(own_id.alias("doc_id"), text.alias("text")), labels, targets, most).dropDuplicates(["row_key", "doc_id"])
    chance = F.pmod(F.xxhash64(F.col("row_key"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(F.col("rate") + 1e-9) + (chance < F.col("rate") + 1e-9 - F.floor(F.col("rate") + 1e-9)).cast("int")).cast("int")
    keep = own.select(F.col("row_key").alias("kept_key"), F.col("doc_id").alias("kept_id"), copies.alias("copies")).where("copies > 0")
    keyed = plain.withColumn("own_key", F.xxhash64(own_id.cast("long"), F.coalesce(text.cast("string"), F.lit(""))))
    # decisions grow with the rows, so they are merged at every size and never broadcast
    joined = keyed.join(keep.hint("merge"), (F.col("own_key") == F.col("kept_key")) & own_id.cast("long").eqNullSafe(F.col("kept_id")))
    if most is None or most > 1:
        joined = joined.select(*names, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return joined.select(*names).toDF(*docs.columns)
