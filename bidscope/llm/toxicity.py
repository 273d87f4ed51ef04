"""Toxicity (operator 4): a linear classifier on character n-grams whose
features are scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed run of 5 or 7 characters of the text
(lower case, white space as single spaces).  On labelled documents the ratio
``r = log((toxic + 1) / (toxic docs + 2)) - log((clean + 1) / (clean docs + 2))``
of every feature is counted, and a logistic regression is fitted to the
features times ``r``.  A score is the logistic of the sum over a whole text.

The intercept is then lowered to the share of toxic labels among all.

Training uses at most ``MAX_PER_CLASS`` documents of each label, those with
the smallest hashes of their ids: one task holds their features, whatever
the size of the corpus.  Scoring is one scan with the weights (a fixed
``2 ** BUCKET_BITS`` numbers) broadcast.  Labels, language, source and ids
are never inputs of a score.

Defined results: null text counts as empty and gets the intercept's score,
as do texts of fewer characters than an n-gram; a document labelled more
than once counts as toxic if any label says so; null labels and null ids are
not learnt from; with no labels of either class the score is the smoothed
share of toxic labels; repeated rows are scored one by one; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, string_array, text_of

MAX_PER_CLASS = 5000
BUCKET_BITS = 20
ORDERS = (5, 7)
EPOCHS = 10
RATE = 0.5
# Held out: rows whose CRC-32 of the id, modulo this, is 0.
FOLDS = 5
# Characters hashed at once.
STRETCH = 1 << 20

_MULTIPLY, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Distinct feature numbers of a text."""

    def __init__(self):
        self.seen = np.zeros(1 << BUCKET_BITS, np.int32)

    def _distinct(self, found: np.ndarray) -> np.ndarray:
        # The last writer of a bucket keeps it.
        order = np.arange(len(found), dtype=np.int32)
        self.seen[found] = order
        return found[self.seen[found] == order]

    def _of(self, codes: np.ndarray) -> np.ndarray:
        short, long = ORDERS
        if len(codes) < short:
            return np.zeros(0, np.int64)
        n = len(codes)
        h = codes[:n - short + 1].copy()
        for k in range(1, short):
            h = h * _MULTIPLY + codes[k:n - short + 1 + k]
        parts = [h]
        if n >= long:
            g = h[:n - long + 1]
            for k in range(short, long):
                g = g * _MULTIPLY + codes[k:n - long + 1 + k]
            parts.append(g + np.uint64(long))
        h = np.concatenate(parts)
        h ^= h >> np.uint64(31)
        h *= _MIX
        return self._distinct((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))

    def __call__(self, text: str) -> np.ndarray:
        plain = f" {' '.join(text.lower().split())} "
        codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(codes) <= STRETCH:
            return self._of(codes)
        step = STRETCH - max(ORDERS) + 1
        return np.unique(np.concatenate([
            self._of(codes[a:a + STRETCH]) for a in range(0, len(codes), step)]))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0,
                      F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learnt from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def training_sample(docs: DataFrame, labels: DataFrame,
                    per_class: int = MAX_PER_CLASS) -> DataFrame:
    """(toxic, text): at most ``per_class`` labelled documents per label."""
    known = known_labels(labels)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(per_class).unionByName(
        known.where("toxic = 0").orderBy(*by_hash).limit(per_class))
    # At most 2 * per_class rows.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(
        F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("x")).select(
        "x.toxic", "x.text")


def _fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    size = 1 << BUCKET_BITS
    toxic = np.array([t for t, _ in rows], np.int64)
    n = len(rows)
    intercept = math.log((toxic.sum() + 1) / (n - toxic.sum() + 1))
    weights = np.zeros(size)
    if not n or not toxic.any() or toxic.all():
        return weights.astype(np.float32), intercept
    counts = np.ones((2, size))
    for label, found in rows:
        counts[label, found] += 1
    ratio = (np.log(counts[1]) - math.log(toxic.sum() + 2)
             - np.log(counts[0]) + math.log(n - toxic.sum() + 2))
    squares, bias = np.full(size, 1e-6), intercept
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(n).tolist():
            label, found = rows[i]
            x = ratio[found]
            z = float(weights[found] @ x) + bias
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
            gradient = error * x
            squares[found] += gradient * gradient
            weights[found] -= RATE * gradient / np.sqrt(squares[found])
            bias -= 0.01 * error
    return (weights * ratio).astype(np.float32), bias


def train(docs: DataFrame, labels: DataFrame,
          per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float]:
    """(weight of every feature, intercept)."""

    def featurise(batches):
        features = Features()
        for batch in batches:
            texts = string_array(batch.column("text"))
            found = [features(t).astype(np.int32) for t in texts.to_pylist()]
            yield pa.record_batch({"toxic": batch.column("toxic"), "found": pa.array(
                found, pa.list_(pa.int32()))})

    def fit(batches):
        rows = [(label, found.values.to_numpy()) for batch in batches
                for label, found in zip(batch.column("toxic").to_pylist(), batch.column("found"))]
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
        weights, bias = _fit(rows)
        yield pa.record_batch({"weights": pa.array([weights.tobytes()], pa.binary()),
                               "bias": pa.array([bias])})

    sample = materialize(training_sample(docs, labels, per_class).mapInArrow(
        featurise, "toxic int, found array<int>"), "toxic-features")
    row = sample.coalesce(1).mapInArrow(fit, "weights binary, bias double").first()
    if row is None:
        return _fit([])
    # The sample holds more toxic documents than their share of all labels.
    of_all = {r.toxic: r.n for r in known_labels(labels).groupBy("toxic").agg(
        F.count("*").alias("n")).collect()}
    drawn = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    shift = 0.0
    if drawn.get(0) and drawn.get(1):
        shift = math.log(of_all[1] / of_all[0]) - math.log(drawn[1] / drawn[0])
    return np.frombuffer(bytes(row.weights), np.float32), row.bias + min(0.0, shift)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    weights = docs.sparkSession.sparkContext.broadcast(model[0])
    bias = float(model[1])

    def scored(batches):
        features = Features()
        for batch in batches:
            z = np.array([float(weights.value[features(t)].sum(dtype=np.float64)) + bias
                          for t in string_array(batch.column("text")).to_pylist()], np.float64)
            value = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": pa.array(value), "predicted": pa.array((value >= 0.5).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       text_of().alias("text")).mapInArrow(
        scored, "doc_id long, held_out boolean, score double, predicted int")


def op4_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
