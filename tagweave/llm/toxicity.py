"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives and a sample of all documents the unlabelled ones; no
document is taken to be clean. A linear classifier in numpy minimises the class-prior-corrected risk
    prior * E_P[l(z)] + max(0, E_U[l(-z)] - prior * E_P[l(-z)]),   l(z) = log(1 + exp(-z)),
where the prior is the share of toxic among the labels learnt from. Features are the beginnings of a
document's distinct words and the words themselves, as far as positives have them more often.

The fit is on bounded samples (Limits); scoring covers whole texts of all documents in one pass
without a shuffle. Null and empty texts score like a text without any known word. Without positive
labels every score is 0. Repeated rows score alike. An empty table gives an empty result. Columns
other than the id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.common import drop, held_out, materialize, prepare

#: Lengths of word beginnings that are features, beside the whole word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Few positives support few features and small weights.
FEATURES_PER_POSITIVE, DECAY = 16, 0.05
STRIP = "".join(map(chr, range(33, 65))) + "[\\]^_`{|}~"


@dataclass(frozen=True)
class Limits:
    """Bounds of the samples that the model is fitted on."""

    positives: int = 3000
    unlabelled: int = 6000
    features: int = 20000


@dataclass
class Model:
    bias: float = -math.inf
    per_log_words: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def scorer(self):
        """text -> score; keeps what each word adds."""
        get, known = self.weights.get, {}

        def of_word(token: str) -> float:
            if len(known) > 500_000:
                known.clear()
            known[token] = value = sum(get(f, 0.0) for f in word_features(token))
            return value

        def score(text: str | None) -> float:
            tokens = distinct_words(text)
            z = self.bias + self.per_log_words * math.log1p(len(tokens)) + math.fsum(known[t] if t in known else of_word(t) for t in tokens)
            return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

        return score


def distinct_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def word_features(token: str) -> list[str]:
    word = token.strip(STRIP)
    return [word[:k] + "*" for k in BEGINNINGS if len(word) >= k] + [word] if word else []


def non_negative_fit(rows: np.ndarray, cols: np.ndarray, log_words: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of n_features, then of log_words, then the bias. rows, cols: where the features are set (a pair may repeat)."""
    w, m, v = (np.zeros(n_features + 2) for _ in range(3))
    w[-1] = math.log(prior / (1 - prior))
    n, n_p, n_u = len(positive), max(1, positive.sum()), max(1, (~positive).sum())
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + w[-2] * log_words + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        loss = np.logaddexp(0, z)  # l(-z)
        negative = loss[~positive].sum() / n_u - prior * loss[positive].sum() / n_p
        g = np.where(positive, prior * (p - 1) / n_p, 0.0)
        pull = np.where(positive, -prior * p / n_p, p / n_u)
        g = g + pull if negative >= 0 else -pull
        grad = np.concatenate([np.bincount(cols, g[rows], n_features) + decay * w[:n_features], [(g * log_words).sum(), g.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Model:
    """Learns from rows that are not held out alone; of labels, from the toxic ones and their share."""
    spark = prepare(docs.sparkSession)
    own = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return Model()
    prior = min(prior, 0.9)
    ids = lambda df, salt, n: df.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)
    chosen = ids(own.where("toxic = 1"), 1, limits.positives).withColumn("positive", F.lit(True))
    chosen = chosen.union(ids(docs.where(~held_out(F.col("doc_id"))), 2, limits.unlabelled).distinct().withColumn("positive", F.lit(False)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most positives + unlabelled ids
    sample = materialize(texts.dropDuplicates(["doc_id", "positive"]).select("positive", "text"), "toxic-sample")

    def counted(among: frozenset[str] | None):
        """Documents that have each feature, of all features or those among some."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = lambda t: {f for w in distinct_words(t) for f in word_features(w) if among is None or f in among}
            found = Counter(f for b in batches for t in b.column(1) for f in of(t.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["f", "n"])

        return run

    def sums(kind: bool, among: frozenset[str] | None = None) -> DataFrame:
        return sample.where(F.col("positive") == kind).mapInArrow(counted(among), "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n >= 4")

    in_positive = {r.f: r.n for r in sums(True).orderBy(F.desc("n"), "f").limit(4 * limits.features).toLocalIterator()}
    in_others = {r.f: r.n for r in sums(False, frozenset(in_positive)).toLocalIterator()}
    size = {r.positive: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not size.get(True):  # no labelled toxic document is among docs
        drop(sample)
        return Model()
    gain = {}
    for f, n in in_positive.items():
        often, else_often = (n + 0.5) / (size[True] + 1), (in_others.get(f, 0) + 0.5) / (size.get(False, 0) + 1)
        if often >= 1.5 * else_often:
            gain[f] = math.log(often / else_often) * math.sqrt(often)
    names = sorted(gain, key=lambda f: (-gain[f], f))[: min(limits.features, FEATURES_PER_POSITIVE * size[True])]
    index = {f: i for i, f in enumerate(names)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sizes = [], []
            for t in b.column(1):
                words = distinct_words(t.as_py())
                sizes.append(len(words))
                sets.append([index[f] for w in words for f in word_features(w) if f in index])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(sets, pa.list_(pa.int32()))], names=["positive", "n", "f"])

    decay = DECAY / size[True]

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(batches)
        marks, lists = got["positive"].to_numpy(), got["f"].combine_chunks()
        cols, rows = lists.flatten().to_numpy(), np.repeat(np.arange(len(marks)), np.diff(lists.offsets.to_numpy()))
        w = non_negative_fit(rows, cols, np.log1p(got["n"].to_numpy()), marks, len(names), prior, decay=decay)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w)], names=["i", "w"])

    # one task on the bounded sample's feature numbers, so that the driver holds weights only
    w = {r.i: r.w for r in sample.mapInArrow(indexed, "positive boolean, n int, f array<int>").repartition(1).mapInArrow(trained, "i long, w double").collect()}
    drop(sample)
    return Model(w[len(names) + 1], w[len(names)], {f: w[i] for i, f in enumerate(names) if w[i]})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most Limits.features weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that score under the threshold; scored as they pass, without a join."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
