"""Quality by a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. A line's evidence is linear in features of itself
and of the lines before and after it; a transition table couples neighbouring labels. Exact marginals
come from the forward-backward recursion, and their mean by line length is the document's share of
good text, which a two-parameter logistic curve turns into a probability of good quality.

Labels mark documents, so lines get theirs in two rounds: first every line has its document's label
and a logistic model of a single line's features learns from them; then lines of bad documents which
that model holds to be good count as good, and the field is trained on the result.

The fit is on a bounded sample (SAMPLE documents, SAMPLE_BYTES of text), in one task; scoring covers whole texts of all documents in one
pass without a shuffle. Null and empty texts, which have no line, get the prior share of good
documents. Without labels of both kinds that prior is every score (1 if there are none). Repeated rows
score alike. An empty table gives an empty result. Columns other than the id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm import textkit
from tagweave.llm.common import held_out, prepare

#: Labelled documents that the model is fitted on, at most, and bytes of their texts; the first document counts whole.
SAMPLE, SAMPLE_BYTES = 4000, 16 << 20
FEATURES = 14

_UPPER, _LETTER, _SYMBOL, _DIGIT, _BAR = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[192:] = 1  # first bytes of other letters
_SYMBOL[[ord(c) for c in "!#$%&*+/<=>@[]^_{|}~\\"]] = 1
_DIGIT[48:58] = 1
_BAR[ord("|")] = 1


@dataclass
class Lines:
    """Lines with words, of many texts. of: each line's text; length: its bytes; own: its features."""

    of: np.ndarray
    length: np.ndarray
    own: np.ndarray

    def features(self) -> np.ndarray:
        """Own features, those of the lines before and after in the same text (0 where none), and 1."""
        same = (self.of[1:] == self.of[:-1])[:, None]
        before, after = np.zeros_like(self.own), np.zeros_like(self.own)
        before[1:] = self.own[:-1] * same
        after[:-1] = self.own[1:] * same
        return np.hstack([self.own, before, after, np.ones((len(self.of), 1))])


def lines_of(texts: list[bytes]) -> Lines:
    w = textkit.words(texts)
    if not len(w.start):
        return Lines(np.empty(0, np.int64), np.empty(0), np.empty((0, FEATURES)))
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.start)
    head = np.flatnonzero(np.diff(line, prepend=-1))  # each line's first word
    begin = np.concatenate([[0], breaks + 1])[line[head]]
    end = breaks[line[head]]
    of = w.of[head]
    length = (end - begin).astype(float)
    count = np.diff(np.append(head, len(line))).astype(float)

    edges = np.column_stack([begin, end]).ravel()

    def total(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[w.data], edges, dtype=np.int64)[::2].astype(float)

    def shared(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flag.astype(float), head) / count

    again = np.zeros(len(line), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    letters = np.maximum(total(_LETTER), 1)
    upper, symbol, digit, bar = total(_UPPER) / letters, total(_SYMBOL) / length, total(_DIGIT) / length, total(_BAR) / count
    repeats = shared(again)
    content = textkit.mixed(np.add.reduceat(textkit.mixed(w.hash + np.arange(len(line), dtype=np.uint64) - np.repeat(head, count.astype(int)).astype(np.uint64)), head) + of.astype(np.uint64))
    _, inverse, times = np.unique(content, return_inverse=True, return_counts=True)
    copies = times[inverse]
    long_words = shared((w.end - w.start) > 14)
    own = np.column_stack(
        [np.log1p(length) / 8, np.log1p(count) / 6, upper, upper > 0.5, symbol * 5, symbol > 0.05, digit * 5, np.minimum(bar, 1), bar > 0.2, repeats, repeats > 0.3, copies > 1, np.log(copies), long_words]
    )
    return Lines(of, length, own.astype(float))


def _steps(of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lines by their place in their text: at each place, the lines there and those before them that go on."""
    place = np.arange(len(of)) - np.searchsorted(of, of)
    order = np.argsort(place, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(of) else ()


def marginals(evidence: np.ndarray, of: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the probability of good, and the sums over neighbours of each pair of labels' probability.

    evidence: log odds of good by the line alone; table[i, j]: score of label j after label i.
    """
    n = len(of)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.column_stack([np.zeros(n), evidence])
    steps = list(_steps(of))
    for k, at in enumerate(steps):
        if k:
            came = forward[at - 1]
            forward[at] = np.logaddexp(came[:, :1] + table[0], came[:, 1:] + table[1])
        forward[at] += emit[at]
        forward[at] -= forward[at].max(axis=1, keepdims=True)
    for at in steps[:0:-1]:
        goes = backward[at] + emit[at]
        backward[at - 1] = np.logaddexp(goes[:, :1] + table[:, 0], goes[:, 1:] + table[:, 1])
        backward[at - 1] -= backward[at - 1].max(axis=1, keepdims=True)
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50)))
    pairs = np.zeros((2, 2))
    at = np.flatnonzero(of[1:] == of[:-1]) + 1
    if len(at):
        joint = forward[at - 1][:, :, None] + table + (emit[at] + backward[at])[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        pairs = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, pairs


def _adam(grad, w: np.ndarray, steps: int, rate: float = 0.05) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 300, decay: float = 1e-3) -> np.ndarray:
    return _adam(lambda w: x.T @ (weight * (1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y)) / weight.sum() + decay * w, np.zeros(x.shape[1]), steps)


@dataclass
class Model:
    prior: float = 1.0
    weights: np.ndarray | None = None
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float] = (1.0, 0.0)

    def line_marginals(self, lines: Lines) -> np.ndarray:
        return marginals(lines.features() @ self.weights, lines.of, self.table)[0]

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """Each text's share of good by line length; nan without lines."""
        lines = lines_of(texts)
        total = np.bincount(lines.of, lines.length, len(texts))
        with np.errstate(invalid="ignore"):
            return np.bincount(lines.of, lines.length * self.line_marginals(lines), len(texts)) / total

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        share = self.shares(texts)
        return np.where(np.isnan(share), self.prior, 1 / (1 + np.exp(-(self.curve[0] * _logit(np.nan_to_num(share)) + self.curve[1]))))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def train(texts: list[bytes], good: np.ndarray) -> Model:
    model = Model(prior=float(good.mean()) if len(good) else 1.0)
    if not len(good) or good.min() == good.max():
        return model
    lines = lines_of(texts)
    x = lines.features()
    alone = np.hstack([lines.own, x[:, -1:]])
    y = good[lines.of].astype(float)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    y = np.maximum(y, alone @ _logistic(alone, y, balance) > 0)
    joined = np.flatnonzero(lines.of[1:] == lines.of[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[joined].astype(int), y[joined + 1].astype(int)), 1)

    def grad(w: np.ndarray) -> np.ndarray:
        p, pairs = marginals(x @ w[:-4], lines.of, w[-4:].reshape(2, 2))
        return np.concatenate([x.T @ (p - y), (pairs - seen).ravel()]) / len(y) + 1e-3 * w

    w = _adam(grad, np.zeros(x.shape[1] + 4), 120)
    model.weights, model.table = w[:-4], w[-4:].reshape(2, 2)
    share = model.shares(texts)
    on = ~np.isnan(share)
    fitted = _logistic(np.column_stack([_logit(share[on]), np.ones(on.sum())]), good[on].astype(float), np.ones(on.sum()), decay=1e-4)
    model.curve = (max(0.0, float(fitted[0])), float(fitted[1]))
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from labels of rows that are not held out."""
    prepare(docs.sparkSession)
    own = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # at most `sample` ids
    rows = texts.select("quality", "text", "doc_id").repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, left = [], [], sample_bytes
        for b in batches:
            for mark, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                left -= len(raw)
                if left >= 0 or not texts:
                    texts.append(raw)
                    marks.append(mark)
        m = train(texts, np.array(marks))
        found = {"prior": m.prior, "weights": None if m.weights is None else m.weights.tolist(), "table": m.table.ravel().tolist(), "curve": list(m.curve)}
        yield pa.RecordBatch.from_pylist([found], pa.schema([("prior", pa.float64()), *((c, pa.list_(pa.float64())) for c in ("weights", "table", "curve"))]))

    r = rows.mapInArrow(trained, "prior double, weights array<double>, table array<double>, curve array<double>").first()
    return Model(r.prior, None if r.weights is None else np.array(r.weights), np.array(r.table).reshape(2, 2), tuple(r.curve)) if r else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few dozen numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in textkit.blocks(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shared.value.scores(texts), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def lines(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, line (its place among the document's lines that have words) and good, the line's marginal."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, texts in textkit.blocks(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))):
                found = lines_of(texts)
                good = shared.value.line_marginals(found) if shared.value.weights is not None else np.full(len(found.of), shared.value.prior)
                place = np.arange(len(found.of)) - np.searchsorted(found.of, found.of)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found.of], pa.int64()), pa.array(place, pa.int64()), pa.array(good, pa.float64())], names=["doc_id", "line", "good"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, line long, good double")
