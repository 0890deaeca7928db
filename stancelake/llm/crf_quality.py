"""Document quality from a linear-chain conditional random field over lines.

Every line that isn't blank is good or bad. Its features describe its own
characters and words and those of the lines before and after it; the chain's
transitions tie neighbours together. Forward-backward gives every line's
marginal of being good, the length-weighted mean of which, through a fitted
logistic curve, is the document's score. Documents carry the labels, so
training takes a document's label as that of each of its lines, in chains of
at most `CHAIN` lines.

Line features are counted in NumPy over all characters of a run of texts at
once; no text is cut short. A document of more than `LONG` lines gets its
forward-backward pass line by line instead of beside others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many labelled documents are used for fitting, those with the smallest hashes of their ids.
FIT_DOCUMENTS = 6000
#: Of a longer document so many lines are fitted on, in runs of CHAIN spread evenly over it.
FIT_LINES = 512
CHAIN, LONG = 64, 2000
CHARS_AT_ONCE = 400_000
THRESHOLD = 0.7
SHARPNESS = 8.0

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK = range(7)
_CLASS = np.full(0x250, MARK, dtype=np.uint8)
for _c in range(0x250):
    _s = chr(_c)
    _CLASS[_c] = LINE if _s == "\n" else SPACE if _s.isspace() else DIGIT if _s.isdigit() else UPPER if _s.isupper() else LOWER if _s.isalpha() else STOP if _s in ".,;:?'\"()-" else MARK
_MIX = (np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
N_OWN, REPEAT = 20, 11


def _scrambled(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: sums and small numbers no longer meet by their structure."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pieces(text: str, size: int) -> Iterator[str]:
    """A text cut at line breaks into pieces of about `size` characters; a longer line stays whole."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size)
        cut = cut if cut > at else text.find("\n", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def line_features(texts: list[str], size: int = CHARS_AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of every non-blank line, its document's number, its length).

    Very long texts are counted piece by piece; a line is a repeat if it has
    stood anywhere before in its document.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * size:
        parts = [_count([p]) for p in pieces(texts[0], size)]
        x, doc, length, sig = (np.concatenate([p[i] for p in parts]) for i in range(4))
        doc = np.zeros(len(x), dtype=np.int64)
    else:
        x, doc, length, sig = _count(texts)
    _, first = np.unique(_scrambled(sig) ^ _scrambled(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
    x[:, REPEAT] = 1
    x[first, REPEAT] = 0
    return x, doc, length


def _count(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As line_features, repeats aside, with a signature of every line's words."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    # a line break after every text keeps documents apart
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), dtype="<u4")
    if not len(code):
        return np.zeros((0, N_OWN)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    cls = np.where(code < 0x250, _CLASS[np.minimum(code, 0x24F)], LOWER)
    is_line = cls == LINE
    line = np.cumsum(is_line) - is_line  # the break belongs to the line that it ends
    n = int(line[-1]) + 1
    ends = np.flatnonzero(is_line)
    doc = np.searchsorted(np.cumsum(lens + 1), ends, side="right")
    counts = np.bincount(line * 7 + cls, minlength=n * 7).reshape(n, 7).astype(float)
    length = counts[:, [LOWER, UPPER, DIGIT, SPACE, STOP, MARK]].sum(axis=1)
    gap = (cls == SPACE) | is_line
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(start):
        return np.zeros((0, N_OWN)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    word = np.cumsum(np.bincount(start, minlength=len(code)).astype(np.int64)) - 1
    inside = ~gap
    w = word[inside]
    place = (np.flatnonzero(inside) - start[w]).astype(np.uint64)
    with np.errstate(over="ignore"):
        mixed = _MIX[code[inside] & 1023] * (place * np.uint64(2) + np.uint64(1))
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        sig = _scrambled(np.add.reduceat(mixed, first))
    wl = line[start]
    words = np.bincount(wl, minlength=n).astype(float)
    again = np.zeros(len(sig))
    again[1:] = (sig[1:] == sig[:-1]) & (wl[1:] == wl[:-1])
    skip = np.zeros(len(sig))
    skip[2:] = (sig[2:] == sig[:-2]) & (wl[2:] == wl[:-2])
    key = sig ^ _scrambled(wl.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(key, return_index=True)
    distinct = np.bincount(wl[at], minlength=n)
    with np.errstate(over="ignore"):
        whole = np.zeros(n, dtype=np.uint64)
        lf = np.flatnonzero(np.concatenate([[True], wl[1:] != wl[:-1]]))
        whole[wl[lf]] = np.add.reduceat(sig * (np.arange(len(sig), dtype=np.uint64) - lf[np.searchsorted(lf, np.arange(len(sig)), side="right") - 1].astype(np.uint64) + np.uint64(1)), lf)
    last = np.where(ends > 0, cls[np.maximum(ends - 1, 0)], LINE)
    begin = np.concatenate([[0], ends[:-1] + 1])
    bang = np.bincount(line, weights=code == 33, minlength=n)
    bar = np.bincount(line, weights=code == 124, minlength=n)
    safe, sw = np.maximum(length, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    up, dig, mark, stop = counts[:, UPPER] / letters, counts[:, DIGIT] / safe, counts[:, MARK] / safe, counts[:, STOP] / safe
    x = np.stack(
        [np.log1p(length), np.log1p(words), np.minimum(length / sw, 30), up, dig, mark, stop, (last == STOP).astype(float), np.bincount(wl, weights=again, minlength=n) / sw, np.bincount(wl, weights=skip, minlength=n) / sw,
         distinct / sw, np.zeros(n), (cls[begin] == UPPER).astype(float), bang / sw, bar / sw, (up > 0.6).astype(float), (mark > 0.04).astype(float), (dig > 0.3).astype(float), (words < 4).astype(float), (distinct < 0.5 * words).astype(float)],
        axis=1,
    )
    keep = words > 0
    return x[keep], doc[keep], length[keep].astype(np.int64), whole[keep]


def with_neighbours(x: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), and whether there is none."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    same = doc[1:] == doc[:-1]
    if n > 1:
        before[1:][same] = x[:-1][same]
        after[:-1][same] = x[1:][same]
    first, last = np.ones(n), np.ones(n)
    first[1:], last[:-1] = ~same, ~same
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((n, 1))], axis=1)


def _grid(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains by falling size: (order, row of each chain's first line, how many chains have line t)."""
    order = np.argsort(-sizes, kind="stable")
    active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
    return order, starts[order], active


def marginals(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of every line, log Z of every chain, and the sum of the pairs' marginals.

    s: the good state's score of every line (bad: 0); trans[a, b]: from a to b.
    """
    p, log_z, pairs = np.zeros(len(s)), np.zeros(len(sizes)), np.zeros((2, 2))
    order, first, active = _grid(starts, sizes)
    if not len(active):
        return p, log_z, pairs
    alpha = np.zeros((len(s), 2))
    beta = np.zeros((len(s), 2))
    alpha[first, 1] = s[first]
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] = np.logaddexp(a[:, 0] + trans[0, 0], a[:, 1] + trans[1, 0])
        alpha[at, 1] = np.logaddexp(a[:, 0] + trans[0, 1], a[:, 1] + trans[1, 1]) + s[at]
    ends = starts + sizes - 1
    log_z[:] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        b0, b1 = beta[at, 0], beta[at, 1] + s[at]
        beta[at - 1, 0] = np.logaddexp(trans[0, 0] + b0, trans[0, 1] + b1)
        beta[at - 1, 1] = np.logaddexp(trans[1, 0] + b0, trans[1, 1] + b1)
    z = np.repeat(log_z, sizes)
    p = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - z, -700, 0))
    inner = np.ones(len(s), dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    for a in range(2):
        for b in range(2):
            pairs[a, b] = np.exp(np.clip(alpha[i - 1, a] + trans[a, b] + beta[i, b] + (s[i] if b else 0) - z[i], -700, 0)).sum()
    return p, log_z, pairs


def long_marginals(s: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """As marginals, for one long chain: the log-odds of good go forth and back, a line at a time."""
    t00, t01, t10, t11 = (math.exp(x) for x in trans.ravel())

    def sweep(scores: list[float], x00: float, x01: float, x10: float, x11: float) -> list[float]:
        out, r = [], 0.0
        for i, own in enumerate(scores):
            if i:
                e = math.exp(max(-700.0, min(700.0, r)))
                r = math.log((x01 + e * x11) / (x00 + e * x10))
            r += own
            out.append(r)
        return out

    scores = s.tolist()
    fore = np.array(sweep(scores, t00, t01, t10, t11))
    back = np.array(sweep(scores[::-1], t00, t10, t01, t11)[::-1])
    return 1 / (1 + np.exp(-np.clip(fore + back - s, -700, 700)))


@dataclass
class Model:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    trans: np.ndarray
    curve: tuple[float, float]
    empty: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights

    def line_marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, doc, length = line_features(texts)
        if not len(x):
            return np.zeros(0), doc, length
        s = self.scores(with_neighbours((x - self.mean) / self.sd, doc))
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        sizes = np.diff(np.append(starts, len(doc)))
        short = sizes <= LONG
        p = np.zeros(len(s))
        if short.all():
            p = marginals(s, starts, sizes, self.trans)[0]
        else:
            rows = np.repeat(short, sizes)
            own = sizes[short]
            p[rows] = marginals(s[rows], np.concatenate([[0], np.cumsum(own)[:-1]]).astype(np.int64) if len(own) else own, own, self.trans)[0]
            for i in np.flatnonzero(~short):
                at = slice(starts[i], starts[i] + sizes[i])
                p[at] = long_marginals(s[at], self.trans)
        return p, doc, length

    def raw(self, texts: list[str]) -> np.ndarray:
        """The length-weighted mean marginal of every text; nan for one without words."""
        p, doc, length = self.line_marginals(texts)
        weight = np.bincount(doc, weights=length, minlength=len(texts))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.bincount(doc, weights=length * p, minlength=len(texts)) / weight

    def quality(self, texts: list[str]) -> np.ndarray:
        out = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (end == at or size + len(texts[end]) <= CHARS_AT_ONCE):
                size += len(texts[end])
                end += 1
            out.append(self.raw(texts[at:end]))
            at = end
        q = np.concatenate(out) if out else np.zeros(0)
        a, b = self.curve
        with np.errstate(invalid="ignore"):
            return np.where(np.isnan(q), self.empty, 1 / (1 + np.exp(-(a * logit(q) + b))))


def logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """A weakly penalised logistic curve by Newton steps."""
    z = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(texts: list[str], labels: list[int], steps: int = 250, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """A model from labelled texts (see fit_lines)."""
    return fit_lines([fitted_lines(t) for t in texts], labels, steps, rate, ridge)


def fitted_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, lengths) of the lines of a text, those of long texts thinned to FIT_LINES (see there)."""
    x, _, length = line_features([text])
    x, length = x.astype(np.float32), length.astype(np.float32)
    if len(x) > FIT_LINES:
        runs = FIT_LINES // CHAIN
        first = np.linspace(0, len(x) - CHAIN, runs).astype(np.int64)
        rows = np.unique(first[:, None] + np.arange(CHAIN)[None, :])
        x, length = x[rows], length[rows]
    return x, length


def fit_lines(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = 250, rate: float = 0.05, ridge: float = 1e-3) -> Model:
    """A model from the lines' features and lengths of labelled documents.

    Without documents of both labels: scores are the labels' mean (0.5 without any).
    """
    y = np.array(labels, dtype=float)
    prior = float(y.mean()) if len(y) else 0.5
    blank = np.array([len(x) == 0 for x, _ in found], dtype=bool)
    empty = float(y[blank].sum() / (blank.sum() + 1))
    width = 3 * N_OWN + 3
    if len(set(labels)) < 2 or blank.all():
        x = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(N_OWN), np.ones(N_OWN), np.zeros(width), np.zeros((2, 2)), (0.0, math.log(x / (1 - x))), empty)
    x, length = (np.concatenate([f[i] for f in found]).astype(np.float64) for i in range(2))
    doc = np.repeat(np.arange(len(found)), [len(f[1]) for f in found])
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = with_neighbours((x - mean) / sd, doc)
    row = np.arange(len(doc))
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    since = row - np.maximum.accumulate(np.where(first, row, 0))
    starts = np.flatnonzero(first | (since % CHAIN == 0))
    sizes = np.diff(np.append(starts, len(doc)))
    chain_y = y[doc[starts]]
    lines = np.bincount(doc, minlength=len(found))
    # a document counts once, spread over its lines by length
    total = np.bincount(doc, weights=np.sqrt(length), minlength=len(found))
    weight = np.sqrt(length) / total[doc] * SHARPNESS
    line_y = y[doc]
    w, trans = np.zeros(z.shape[1]), np.zeros((2, 2))
    inner_good = (sizes - 1)[chain_y == 1].sum()
    inner_bad = (sizes - 1)[chain_y == 0].sum()
    m = [np.zeros_like(w), np.zeros_like(trans)]
    v = [np.zeros_like(w), np.zeros_like(trans)]
    n_docs = max(1, int((lines > 0).sum()))
    for k in range(1, steps + 1):
        p, _, pairs = marginals(z @ w, starts, sizes, trans)
        grad_w = z.T @ ((p - line_y) * weight) / n_docs + ridge * w
        seen = np.array([[inner_bad, 0.0], [0.0, inner_good]])
        grad_t = (pairs - seen) / max(1.0, seen.sum()) + 0.05 * trans
        for j, (value, grad) in enumerate(((w, grad_w), (trans, grad_t))):
            m[j] = 0.9 * m[j] + 0.1 * grad
            v[j] = 0.99 * v[j] + 0.01 * grad**2
            value -= rate * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.99**k)) + 1e-8)
    model = Model(mean, sd, w, trans, (1.0, 0.0), empty)
    q = np.bincount(doc, weights=length * marginals(z @ w, *_whole(doc), trans)[0], minlength=len(found)) / np.maximum(np.bincount(doc, weights=length, minlength=len(found)), 1)
    model.curve = logistic(logit(q[lines > 0]), y[lines > 0])
    return model


def _whole(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return starts, np.diff(np.append(starts, len(doc)))


def held_out(id_col) -> "F.Column":
    """Whether a row is kept from fitting: crc32 of its id's decimal text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCUMENTS) -> Model:
    """Fit on at most `bound` labelled documents that aren't held out.

    Labels of one id are averaged (0.5 and more: good); null ids and null
    labels don't count; nor does a document without a label. Features are
    made where the texts are: the driver gets FIT_LINES lines' numbers of a
    document at most, never a text.
    """
    label = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    label = label.where(~held_out(F.col("_id")))
    chosen = label.orderBy(F.xxhash64("_id"), "_id").limit(bound)  # two numbers a row, at most `bound` rows
    rows = docs.select(docs["doc_id"].cast("long").alias("_id"), docs["text"].cast("string").alias("_text"))
    wide = rows.join(F.broadcast(chosen), "_id").select("_id", "_y", F.xxhash64("_id").alias("_h"), F.xxhash64("_text").alias("_t"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fitted_lines(t or "") for t in batch.column(4).to_pylist()]
            own = [pa.array([m[i].tobytes() for m in made], pa.binary()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *own], names=["_id", "_y", "_h", "_t", "_x", "_n"])

    lines = wide.mapInArrow(run, "_id long, _y int, _h long, _t long, _x binary, _n binary")
    # a fixed order: sums of the fit don't depend on how rows arrive
    sample = lines.orderBy("_h", "_id", "_t").limit(bound).select("_y", "_x", "_n").toPandas()
    found = [(np.frombuffer(x, np.float32).reshape(-1, N_OWN), np.frombuffer(n, np.float32)) for x, n in zip(sample["_x"], sample["_n"], strict=True)]
    return fit_lines(found, [int(x) for x in sample["_y"]])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score`: all columns stay; a column of that name is replaced. Null text: empty."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = docs.columns.index("text")
    schema = T.StructType([*plain.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.quality(texts), type=pa.float64())], names=[*names, "_score"])

    out = plain.mapInArrow(run, schema)
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c != "score"]
    return out.select(*[F.col(n).alias(c) for n, c in kept], F.col("_score").alias("score"))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns as they were, whatever their names.

    A null text counts as empty and is scored like any other; very long texts
    are scored whole, piece by piece; a score equal to the threshold stays; rows
    that repeat a text share its fate; null ids are kept; an empty table gives
    no rows.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.quality([x or "" for x in batch.column(at).to_pylist()]) >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame, bound: int = FIT_DOCUMENTS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    Empty and null texts get the (smoothed) share of good ones among the
    empty texts fitted on. A null id isn't held out. Repeated rows are scored
    each; an empty table gives no rows; other columns aren't read.
    """
    model = fit_on(docs, labels, bound)
    own = score(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), model)
    return own.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
