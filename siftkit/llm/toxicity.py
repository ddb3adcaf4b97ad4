"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic; the unlabelled sample is drawn from all training
documents, whatever their label, and holds toxic ones at the class prior pi (the toxic share
of the labelled training rows).  With logistic loss l and a score g the risk is

    pi * mean_P l(g) + max(0, mean_U l(-g) - pi * mean_P l(-g))

When the second term is negative the classifier overfits; the descent then steps back along
that term alone (the non-negative correction).  A word scores the sum of its character
n-grams' weights, a document ``log(1 + sum of exp(word score))`` over all its different words,
plus a bias and a term for its length: with the weight that is learnt for the length the pool
lies between a sum and a mean, so a long clean text does not add up to a toxic one and no
word is left out.  N-grams are kept that are over ``LEAST_RATIO`` times as
common among the positives as in the unlabelled sample, by a likelihood ratio of
``LEAST_EVIDENCE`` at least.

Scale: the fit uses at most ``POSITIVES`` and ``UNLABELLED`` documents, whose ids are
broadcast; n-grams are counted (tables of at most ``COUNTED`` n-grams a task are passed on) and
chosen in Spark, and the driver gets only the chosen ones of the sample.  Every text is
scored where it lies, whole.

Defined results: empty and null texts score like a text without features.  Without confirmed
positives every score is 0.  Labels that are null, or of ids not in ``documents``, confirm
nothing; of repeated labels one toxic mark suffices.  Rows that repeat a doc_id are scored
alike if their texts are.  Extra columns are ignored by ``score`` and kept by ``drop_toxic``.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .language_id import LETTERS, held_out

POSITIVES = 3_000
UNLABELLED = 9_000
SIZES = (4, 5, 6)
LEAST_RATIO, LEAST_EVIDENCE, LEAST_COUNT = 3.0, 6.0, 3
COUNTED = 1_000_000
STEPS, RATE, DECAY = 400, 0.1, 1e-4
CACHED_WORDS = 400_000


def grams(word: str) -> set[str]:
    """Character n-grams of a lower-case word with its start marked."""
    marked = "^" + word
    return {marked[i:i + k] for k in SIZES for i in range(len(marked) - k + 1)}


def words_of(text: str | None) -> set[str]:
    return set(LETTERS((text or "").lower()))


def features(text: str | None) -> set[str]:
    return {g for w in words_of(text) for g in grams(w)}


class Model:
    """Weights of the chosen n-grams, of the length, and a bias."""

    def __init__(self, weights: dict[str, float], length: float = 0.0, bias: float = 0.0):
        self.weights, self.length, self.bias = weights, length, bias
        self.cache: dict[str, float] = {}

    def word(self, word: str) -> float:
        got = self.cache.get(word)
        if got is None:
            got = sum(self.weights.get(g, 0.0) for g in sorted(grams(word)))
            if len(self.cache) < CACHED_WORDS:
                self.cache[word] = got
        return got

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        words = words_of(text)
        scores = np.sort([0.0, *map(self.word, words)])  # in one order, so that equal texts score alike to the last bit
        pooled = scores[-1] + np.log(np.exp(scores - scores[-1]).sum())
        g = self.bias + self.length * float(np.log1p(len(words))) + pooled
        return float(1 / (1 + np.exp(-np.clip(g, -40, 40))))


class Bags:
    """Documents as bags of words, words as lists of feature numbers, flattened."""

    def __init__(self, docs: list[list[list[int]]], n_words: list[int]):
        words = [(d, w) for d, ws in enumerate(docs) for w in ws]
        self.n, self.n_words = len(docs), np.array(n_words, float)
        self.length = np.log1p(self.n_words)
        self.doc = np.array([d for d, _ in words], int)
        self.word = np.repeat(np.arange(len(words)), [len(w) for _, w in words])
        self.feature = np.array([f for _, w in words for f in w], int)

    def pool(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's log(1 + sum of exp(word score)), and the share of each listed word in it.

        Words without a chosen n-gram are not listed; they score 0.
        """
        s = np.bincount(self.word, weights[self.feature], len(self.doc))
        most = np.zeros(self.n)
        np.maximum.at(most, self.doc, s)
        own = np.exp(s - most[self.doc])
        plain = 1 + self.n_words - np.bincount(self.doc, minlength=self.n)
        total = plain * np.exp(-most) + np.bincount(self.doc, own, self.n)
        return most + np.log(total), own / total[self.doc]

    def gradient(self, share: np.ndarray, slope: np.ndarray, n_features: int) -> np.ndarray:
        """Of the mean over documents, by feature, by the weight of the length and by the bias."""
        own = (share * slope[self.doc])[self.word]
        return np.append(np.bincount(self.feature, own, n_features), [slope @ self.length, slope.sum()]) / max(self.n, 1)


def nn_pu(pos: Bags, unl: Bags, weights: np.ndarray, prior: float,
          steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float, float]:
    """Weights, weight of the length and bias that minimise the non-negative PU risk by Adam steps from ``weights``."""
    def below(g: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(g, -40, 40)))  # the logistic loss falls at this slope

    def loss(g: np.ndarray) -> float:
        return float(np.logaddexp(0, -g).mean()) if len(g) else 0.0

    n = len(weights)
    w = np.append(weights, [-1.0, np.log(prior / (1 - prior)) if prior < 1 else 0.0])
    mean, square = np.zeros(n + 2), np.zeros(n + 2)
    for step in range(1, steps + 1):
        (p, p_share), (u, u_share) = pos.pool(w[:n]), unl.pool(w[:n])
        p, u = p + w[n] * pos.length + w[n + 1], u + w[n] * unl.length + w[n + 1]
        positive = prior * pos.gradient(p_share, -below(p), n)
        negative = unl.gradient(u_share, below(-u), n) - prior * pos.gradient(p_share, below(-p), n)
        grad = positive + negative if loss(-u) - prior * loss(-p) >= 0 else -negative
        grad[:n] += decay * w[:n]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad ** 2
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    return w[:n], float(w[n]), float(w[n + 1])


def _counted(pos: Counter, unl: Counter) -> pa.RecordBatch:
    names = list(pos | unl)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[g] for g in names], pa.int64()),
                                       pa.array([unl[g] for g in names], pa.int64())], names=["gram", "pos", "unl"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pos, unl = Counter(), Counter()
    for batch in batches:
        for text, p, u in zip(batch.column("text"), batch.column("pos").to_pylist(), batch.column("unl").to_pylist()):
            own = features(text.as_py())
            for side, counts in ((p, pos), (u, unl)):
                if side:
                    counts.update(own)
            if len(pos) + len(unl) >= COUNTED:
                yield _counted(pos, unl)
                pos, unl = Counter(), Counter()
    yield _counted(pos, unl)


def _chosen_only(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = set(chosen.value)
        for batch in batches:
            got, sizes = [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                got.append([x for w in sorted(words) if (x := sorted(grams(w) & keep))])
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("unl"), pa.array(sizes, pa.int64()),
                                              pa.array(got, pa.list_(pa.list_(pa.string())))], names=["pos", "unl", "n_words", "words"])
    return run


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on the rows of ``docs`` outside the held-out fold; of ``labels`` only doc_id and toxic are read."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n_marks, n_toxic = marks.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return Model({})
    ids = docs.where(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"))
    by_hash = [F.xxhash64(F.lit(7), F.col("doc_id")), F.col("doc_id")]
    p = marks.where("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(positives)
    u = ids.orderBy(*by_hash).limit(unlabelled).distinct()
    sample = written(p.select("doc_id", F.lit(1).alias("pos"), F.lit(0).alias("unl")).unionAll(
        u.select("doc_id", F.lit(0).alias("pos"), F.lit(1).alias("unl"))).groupBy("doc_id").agg(
        F.max("pos").alias("pos"), F.max("unl").alias("unl")), "toxicity-sample")
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                   .join(F.broadcast(sample), "doc_id").select("text", "pos", "unl"), "toxicity-texts")
    n_pos, n_unl = rows.agg(F.sum("pos"), F.sum("unl")).first()
    if not n_pos or not n_unl:
        return Model({})
    counts = rows.mapInArrow(_count, "gram string, pos long, unl long").groupBy("gram").agg(
        F.sum("pos").alias("pos"), F.sum("unl").alias("unl")).where(F.col("pos") >= LEAST_COUNT)
    expected = (F.col("unl") + 1) / float(n_unl + 1) * float(n_pos)
    evidence = F.col("pos") * F.log(F.col("pos") / expected) - F.col("pos") + expected
    chosen = counts.where((F.col("pos") >= expected * LEAST_RATIO) & (evidence >= LEAST_EVIDENCE))
    kept = sorted(r.gram for r in chosen.select("gram").collect())  # n-grams of the bounded sample's positives
    if not kept:
        return Model({})
    at = {g: i for i, g in enumerate(kept)}
    sample_rows = rows.mapInArrow(_chosen_only(spark.sparkContext.broadcast(kept)), "pos int, unl int, n_words long, words array<array<string>>") \
        .collect()  # at most POSITIVES + UNLABELLED rows, of chosen n-grams only
    sides = [[r for r in sample_rows if r[side]] for side in ("pos", "unl")]
    bags = [Bags([[[at[g] for g in w] for w in r.words] for r in side], [r.n_words for r in side]) for side in sides]
    w, length, bias = nn_pu(*bags, np.full(len(kept), 1.0), n_toxic / n_marks)
    return Model({g: float(w[i]) for g, i in at.items()}, length, bias)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            got = pa.array([m.score(t.as_py()) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), got],
                                             names=[*(c for c in batch.schema.names if c != "text"), "score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, from the text alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns as they were."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = pa.array([m.score(t.as_py()) < 0.5 for t in batch.column("text")], pa.bool_())
            yield batch.select(["record"]).filter(keep)

    return rows.mapInArrow(run, T.StructType([rows.schema["record"]])).select("record.*")
