"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (low quality) and 2 (good). One weight vector over hashed words is shared by all thresholds:
P(grade > j) = sigmoid(w.x - t_j) with t_0 < t_1, which gives an expected grade and a tail probability to select by.

Features of a text (lower-cased, null counts as empty): the words it holds, hashed, by presence; and a few shares of
its whole text (symbols, repeated words, the most frequent word, bars). Learned on at most about `sample` labelled
documents, dealt by a hash of doc_id; labels without grade or document are ignored, of several labels for one
document the worst counts. Without any labelled document every grade is expected at the thresholds' start. Repeated
rows are graded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

BUCKETS = 1 << 18
TOKEN = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[^\x00-\x20\x30-\x39\x41-\x5a\x61-\x7a\x80-\xff]+")
SHARES = 5


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words present, and the shares."""
    counts = Counter(TOKEN.findall(text.lower()))
    n = max(1, sum(counts.values()))
    words = np.fromiter((zlib.crc32(w) & (BUCKETS - 1) for w in counts), np.int64, len(counts))
    symbols = sum(v for w, v in counts.items() if not w[:1].isalnum() and w[0] < 128)
    most = max((v for w, v in counts.items() if w[:1].isalnum() or w[0] > 127), default=0)
    shares = [1.0, symbols / n, len(counts) / n, most / n, counts.get(b"|", 0) / n, min(1.0, np.log1p(n) / 10)]
    return np.unique(words), np.array(shares[1 : SHARES + 1])


@dataclass
class OrdinalModel:
    weights: np.ndarray
    shares: np.ndarray
    thresholds: np.ndarray

    def tails(self, words: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2)."""
        z = self.weights[words].sum() + shares @ self.shares
        return 1 / (1 + np.exp(-np.clip(z - self.thresholds, -30, 30)))


@dataclass
class Design:
    """The learned-on documents: word `at[k]` is in document `doc[k]`; x are the shares."""

    doc: np.ndarray
    at: np.ndarray
    x: np.ndarray
    grades: np.ndarray


def loss_and_slopes(d: Design, w: np.ndarray, v: np.ndarray, t: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with the ridge's penalty, and its slopes by word weights, share weights and thresholds."""
    n = len(d.grades)
    index, ones, none = np.arange(n), np.ones(n), np.zeros(n)
    z = np.bincount(d.doc, w[d.at], n) + d.x @ v
    s = 1 / (1 + np.exp(-np.clip(z - t[:, None], -30, 30)))
    tail, slope = np.stack([ones, s[0], s[1], none]), np.stack([none, s[0] * (1 - s[0]), s[1] * (1 - s[1]), none])
    p = np.maximum(tail[d.grades, index] - tail[d.grades + 1, index], 1e-9)
    upper, lower = slope[d.grades, index], slope[d.grades + 1, index]
    g = -(upper - lower) / p / n
    cut = np.array([(np.where(d.grades == j + 1, upper, np.where(d.grades == j, -lower, 0)) / p).sum() / n for j in (0, 1)])
    loss = -np.log(p).mean() + ridge / 2 * (w @ w + v @ v)
    return loss, np.bincount(d.at, g[d.doc], len(w)) + ridge * w, d.x.T @ g + ridge * v, cut


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 300, rate: float = 0.3, ridge: float = 1e-3, least_docs: int = 12) -> OrdinalModel:
    """Adaptive gradient steps on the negative log-likelihood of the cumulative-link model.

    Hashed words in fewer than `least_docs` documents get no weight: they would only learn single labels by heart."""
    model = OrdinalModel(np.zeros(BUCKETS), np.zeros(SHARES), np.array([-1.0, 0.0]))
    if not len(rows):
        return model
    word = np.concatenate([w for w, _ in rows])
    doc = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    common = np.bincount(word, minlength=BUCKETS)[word] >= least_docs
    used, at = np.unique(word[common], return_inverse=True)
    design = Design(doc[common], at, np.stack([s for _, s in rows]), grades)
    values = [np.zeros(len(used)), np.zeros(SHARES), model.thresholds.copy()]
    squares = [np.full(len(x), 1e-8) for x in values]
    for _ in range(rounds):
        for value, slope, square in zip(values, loss_and_slopes(design, *values, ridge)[1:], squares, strict=True):
            square += slope**2
            value -= rate * slope / np.sqrt(square)
        values[2][1] = max(values[2][1], values[2][0] + 1e-3)
    model.weights[used], model.shares, model.thresholds = values
    return model


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, grade of the labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(known, "doc_id")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> OrdinalModel:
    """Fits on at most about `sample` labelled documents; their hashed features come to the driver, never their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or b"") for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([w.astype(np.int32) for w, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float64()))], ["doc_id", "grade", "words", "shares"])

    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(drawn < sample / max(1, labels.count()))
    rows = graded(docs, chosen).select("doc_id", "grade", "text").mapInArrow(run, "doc_id long, grade int, words array<int>, shares array<double>").orderBy("doc_id").toArrow()
    words = [np.asarray(w, np.int64) for w in rows["words"].to_pylist()]
    return fit(list(zip(words, map(np.array, rows["shares"].to_pylist()), strict=True)), np.array(rows["grade"].to_pylist(), np.int64))


def score(docs: DataFrame, model: OrdinalModel, least_tail: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_not_toxic, p_good, selected (p_good of at least `least_tail`)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            tails = np.array([model.tails(*features(t or b"")) for t in as_bytes(batch.column("text"))]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (tails.sum(1), tails[:, 0], tails[:, 1], tails[:, 1] >= least_tail))], ["doc_id", "expected_grade", "p_not_toxic", "p_good", "selected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, p_not_toxic double, p_good double, selected boolean")


def grade(docs: DataFrame, labels: DataFrame, sample: int = 6000, least_tail: float = 0.5) -> DataFrame:
    """Learns from the labels and grades every document."""
    return score(docs, learn(docs, labels, sample), least_tail)
